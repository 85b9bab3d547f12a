"""Cleaning operators over each tag's timeline. Input columns: tag, ts, seq and those named."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.functions.times import seconds_between
from rivertrack.operators.timeline import (
    first_where,
    is_sliced,
    previous,
    timeline,
)


def dedup_keep_first(df: DataFrame, by=("tag", "ts"), order=("seq",)) -> DataFrame:
    """The first row in file order of each (tag, time).

    Spark applies a row-number-equals-one filter before the shuffle as well, so a group of
    copies, however large, leaves each task as one row.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def detection_lag(df: DataFrame) -> DataFrame:
    """Add ``lag_s``, seconds since the tag's preceding row; NULL on its first."""
    return (
        previous(df, {"_ts": "ts"}).withColumn("lag_s", seconds_between("ts", "_ts")).drop("_ts")
    )


def _keeps_gap(min_gap: float) -> Column:
    return F.col("lag_s").isNull() | (F.col("lag_s") >= min_gap)


def _is_lost(lost_gap: float, tolerance: float, methods) -> Column:
    if tolerance:
        gap = F.col("lag_s").between(lost_gap - tolerance, lost_gap + tolerance)
    else:
        gap = F.col("lag_s") == lost_gap
    return gap & F.col("method").isin(*methods)


def min_gap_filter(df: DataFrame, min_gap: float = K.PULSE_SECONDS) -> DataFrame:
    """Drop rows closer than ``min_gap`` seconds to the preceding raw row (kept or not)."""
    return detection_lag(df).where(_keeps_gap(min_gap))


def lost_tag_flag(
    df: DataFrame,
    lost_gap: float = K.LOST_GAP_SECONDS,
    tolerance: float = 0.0,
    methods=("Fixed", "Mobile"),
) -> DataFrame:
    """Set ``method`` to ``Lost Tag`` where the gap is the mortality signal. A first row has no
    gap and keeps its method."""
    lost = _is_lost(lost_gap, tolerance, methods)
    return detection_lag(df).withColumn(
        "method", F.when(lost, F.lit("Lost Tag")).otherwise(F.col("method"))
    )


def gap_gate(
    df: DataFrame,
    min_gap: float = K.PULSE_SECONDS,
    lost_gap: float = K.LOST_GAP_SECONDS,
    tolerance: float = 0.0,
) -> DataFrame:
    """``min_gap_filter`` then the lost-tag flag, both on the gap between raw rows."""
    lost = _is_lost(lost_gap, tolerance, ("Fixed", "Mobile"))
    return (
        detection_lag(df)
        .where(_keeps_gap(min_gap))
        .withColumn("method", F.when(lost, F.lit("Lost Tag")).otherwise(F.col("method")))
        .drop("lag_s")
    )


def lost_tags(
    df: DataFrame, lost_gap: float = K.LOST_GAP_SECONDS, tolerance: float = 0.0
) -> DataFrame:
    """Tags with a mortality-signal gap and when it was first seen."""
    lagged = detection_lag(df)
    if tolerance:
        gap = F.col("lag_s").between(lost_gap - tolerance, lost_gap + tolerance)
    else:
        gap = F.col("lag_s") == lost_gap
    return (
        lagged.where(gap)
        .groupBy("tag")
        .agg(F.lit(1).cast("bigint").alias("unique_tags"), F.min("ts").alias("earliest"))
    )


def terminal_zone_lock(df: DataFrame, zone: str) -> DataFrame:
    """Once a tag has reached ``zone``, drop its later rows anywhere else."""
    reached = first_where(df, F.col("zone") == zone, "_reached")
    after = F.struct("ts", "seq") > F.col("_reached")
    elsewhere = ~F.col("zone").eqNullSafe(F.lit(zone))
    return reached.where(~(F.coalesce(after, F.lit(False)) & elsewhere)).drop("_reached")


def reach_flag_cumsum(df: DataFrame, zone: str) -> DataFrame:
    """Add ``flag`` (1 on the tag's first row in ``zone``) and ``reached``, its running sum."""
    here = F.struct("ts", "seq")
    flagged = first_where(df, F.col("zone") == zone, "_f").withColumn(
        "flag", F.coalesce((here == F.col("_f")).cast("int"), F.lit(0))
    )
    if is_sliced(df):
        # the sum over earlier slices is 1 if the flag lies there
        upto = F.coalesce((here >= F.col("_f")).cast("bigint"), F.lit(0))
    else:
        rows = timeline(df).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = F.sum("flag").over(rows)
    return flagged.withColumn("reached", upto).drop("_f")


def movement_rates(df: DataFrame) -> DataFrame:
    """Add ``distance`` (rkm), ``lag_days`` and ``rate`` (rkm/day, NULL at lag 0)."""
    return (
        previous(df, {"_ts": "ts", "_rkm": "rkm"})
        .withColumn("distance", F.abs(F.col("rkm") - F.col("_rkm")))
        .withColumn("lag_days", seconds_between("ts", "_ts") / 86400.0)
        .withColumn("rate", F.try_divide("distance", "lag_days"))
        .drop("_ts", "_rkm")
    )


def is_impossible(
    distance: Column, lag_days: Column, max_distance: float, max_rate: float
) -> Column:
    """Too far and too fast, without dividing: a jump at lag 0 is impossible too."""
    return (distance > max_distance) & (distance > lag_days * max_rate)


def impossible_moves(
    df: DataFrame,
    max_distance: float = K.MAX_DISTANCE_RKM,
    max_rate: float = K.MAX_RATE_RKM_PER_DAY,
) -> DataFrame:
    """The rows reached by an impossible move from the preceding row."""
    bad = is_impossible(F.col("distance"), F.col("lag_days"), max_distance, max_rate)
    return movement_rates(df).where(bad)


def strongest_mobile(df: DataFrame, clustered: bool = False) -> DataFrame:
    """Of a tag's mobile rows on one day, only those at maximum power (ties kept; rows without
    power go). Other rows pass through untouched.

    The peaks are one aggregation, combined map-side, and a semi-join; only mobile rows are
    shuffled and a day with many rows can be split. Inside a chain whose rows are already
    clustered by tag, ``clustered`` takes the peak with a window instead: no further shuffle.
    """
    mobile = F.col("method").eqNullSafe(F.lit("Mobile"))
    if clustered and not is_sliced(df):
        peak = F.max(F.when(mobile, F.col("power"))).over(Window.partitionBy("tag", "date"))
        at_peak = F.coalesce(F.col("power") == F.col("_peak"), F.lit(False))
        return df.withColumn("_peak", peak).where(~mobile | at_peak).drop("_peak")
    rows = df.where(mobile)
    peaks = rows.groupBy("tag", "date").agg(F.max("power").alias("power"))
    return df.where(~mobile).unionByName(rows.join(peaks, ["tag", "date", "power"], "left_semi"))
