"""Tables behind the maps and the history panels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.functions.keys import normalise_key, pad_two_digit_code
from rivertrack.operators.arrivals import last_detection
from rivertrack.operators.lookups import first_match
from rivertrack.operators.reports import history_panel, study_locations
from rivertrack.operators.spatial import (
    bbox_membership,
    jitter_points,
    project_utm,
    survey_slices,
    vertex_attribute_join,
)
from rivertrack.schema import FIXED_LOCATIONS, fixed_table
from rivertrack.sources.files import read_csv


def fixed_station_points(spark, path) -> DataFrame:
    """Fixed locations file, projected."""
    places = read_csv(spark, path, FIXED_LOCATIONS).withColumnsRenamed(
        {"Station": "station", "Latitude": "lat", "Longitude": "long"}
    )
    return project_utm(places)


def map_streams(vertices: DataFrame, attributes: DataFrame) -> DataFrame:
    """Vertices of the larger streams."""
    return vertex_attribute_join(vertices, attributes, F.col("STRMRDR") >= K.MIN_STREAM_ORDER)


def map_roads(vertices: DataFrame, attributes: DataFrame) -> DataFrame:
    """Vertices of the main roads."""
    main = F.col("ROAD_CLASS").isin(*K.MAP_ROAD_CLASSES)
    return vertex_attribute_join(vertices, attributes, main)


def map_lakes(vertices: DataFrame, attributes: DataFrame) -> DataFrame:
    """Vertices of the named lakes."""
    return vertex_attribute_join(vertices, attributes, F.col("GNSNM1").isNotNull())


def survey_jitter(jitter: float = K.SURVEY_JITTER, by_day: dict | None = None) -> Column:
    """How far points of a survey day are moved: ``jitter``, except on the days of ``by_day``."""
    by_day = K.SURVEY_JITTERS if by_day is None else by_day
    days = [(F.col("date") == F.lit(d).cast("date"), F.lit(m)) for d, m in by_day.items()]
    return F.coalesce(first_match(days), F.lit(jitter)) if days else F.lit(jitter)


def survey_points(
    det: DataFrame,
    dates=tuple(K.SURVEY_DATES),
    jitter: float = K.SURVEY_JITTER,
    by_day: dict | None = None,
) -> DataFrame:
    """Mobile rows by survey day, projected and jittered: what all maps of surveys are drawn of.
    Write them with ``spatial.write_by_place``, and each map reads its part (``in_extent``)."""
    points = project_utm(survey_slices(det, dates))
    return jitter_points(points, survey_jitter(jitter, by_day))


def survey_maps(
    det: DataFrame,
    dates=tuple(K.SURVEY_DATES),
    jitter: float = K.SURVEY_JITTER,
    by_day: dict | None = None,
) -> DataFrame:
    """Mobile rows by survey day and map extent, projected and jittered."""
    return bbox_membership(survey_points(det, dates, jitter, by_day))


def last_detection_points(
    det: DataFrame, jitter: float = K.LAST_DETECTION_JITTER
) -> DataFrame:
    """Last detection of each assigned tag, projected and jittered."""
    spark = det.sparkSession
    bad = fixed_table(spark, [(t,) for t in K.BAD_LAST_DETECTION_TAGS], "tag STRING")
    last = (
        last_detection(det)
        .where(F.col("tag_ts").isNotNull())
        .join(F.broadcast(bad.select(normalise_key("tag").alias("tag"))), "tag", "left_anti")
    )
    return jitter_points(project_utm(last), jitter)


def last_detection_maps(det: DataFrame, jitter: float = K.LAST_DETECTION_JITTER) -> DataFrame:
    """Last detections by map extent."""
    return bbox_membership(last_detection_points(det, jitter))


def detection_history(det: DataFrame) -> DataFrame:
    """Rows of the history panels, keys padded."""
    return history_panel(det.withColumn("tag", pad_two_digit_code("tag")), study_locations())
