"""Fixed stations: downloads to cleaned detections with their tag."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.operators.cleaning import dedup_keep_first
from rivertrack.operators.lookups import after_tagging, exclude_test_tags, station_lookup
from rivertrack.sources.accounts import LineAccount
from rivertrack.sources.files import FILE_ORDER
from rivertrack.sources.receivers import line_kinds, of_kind, receiver_lines


def fixed_lines(
    spark: SparkSession, directories: list[str], station_of: dict[str, str] | None = None
) -> DataFrame:
    """All lines of the stations' downloads by kind, one directory after the other."""
    station_of = station_of or {}
    scans = [
        receiver_lines(
            spark, directory, station=station_of.get(directory), deploy_start=K.DEPLOY_START
        ).withColumn("_place", F.lit(i))
        for i, directory in enumerate(directories)
    ]
    return reduce(DataFrame.unionByName, scans)


def fixed_raw(
    spark: SparkSession,
    directories: list[str],
    station_of: dict[str, str] | None = None,
    account: LineAccount | None = None,
) -> DataFrame:
    """Downloads of the stations, one directory each: first row per (tag, second) in file order,
    from the deployment's first day. Stations keep their order in the list where two hear a tag
    in the same second. ``station_of`` maps a directory to the station all its rows are. With an
    ``account``, all lines are counted in it by kind."""
    lines = fixed_lines(spark, directories, station_of)
    if account is not None:
        lines = account.watch("records", lines, line_kinds())
    rows = of_kind(lines, "kept")
    # numbered anew over all scans, whose splits follow one another in the order of the list
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    first = dedup_keep_first(rows, by=("_place", "tag", "ts"), order=FILE_ORDER)
    return first.drop("_place")


def fixed_quarantine(
    spark: SparkSession, directories: list[str], account: LineAccount | None = None
) -> DataFrame:
    """The lines of the stations' downloads that are no detections, with file, place and reason."""
    lines = fixed_lines(spark, directories)
    if account is not None:
        lines = account.watch("rejects", lines, line_kinds())
    return of_kind(lines, "rejected")


def fixed_detections(raw: DataFrame, study_start: str = K.STUDY_START, stations=None) -> DataFrame:
    """Without test tags and earlier years; with zone and rkm."""
    kept = exclude_test_tags(raw).where(F.col("date") >= F.lit(study_start).cast("date"))
    return station_lookup(kept, stations).withColumn("method", F.lit("Fixed"))


def fixed_pipeline(
    raw: DataFrame, tags: DataFrame, study_start: str = K.STUDY_START, stations=None
) -> DataFrame:
    return after_tagging(fixed_detections(raw, study_start, stations), tags)
