"""Mobile surveys: records to cleaned detections on the river-kilometre axis."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivertrack.functions.keys import tag_key
from rivertrack.operators.cleaning import dedup_keep_first
from rivertrack.operators.lookups import after_tagging, channel_frequency
from rivertrack.operators.spatial import nearest_reference_point, project_utm
from rivertrack.sources.files import FILE_ORDER


def mobile_raw(srx: DataFrame) -> DataFrame:
    """Add the tag key from channel and code; a channel off the list gives no key."""
    freq = F.col("frequency").try_cast("decimal(6,3)")
    return channel_frequency(srx).withColumns(
        {"freq": freq, "tag": tag_key(freq, "code"), "method": F.lit("Mobile")}
    )


def mobile_initial(raw: DataFrame, tags: DataFrame, order=FILE_ORDER) -> DataFrame:
    """Known tags, after tagging, with a position, first row per (tag, time)."""
    known = after_tagging(raw, tags).where((F.abs("lat") <= 90) & (F.abs("long") <= 360))
    return dedup_keep_first(known, by=("tag", "ts"), order=order)


def mobile_rkm(initial: DataFrame, points: DataFrame) -> DataFrame:
    """River kilometre and zone of the nearest reference point."""
    return nearest_reference_point(project_utm(initial), points)


def mobile_pipeline(
    raw: DataFrame, tags: DataFrame, points: DataFrame, order=FILE_ORDER
) -> DataFrame:
    return mobile_rkm(mobile_initial(raw, tags, order), points)
