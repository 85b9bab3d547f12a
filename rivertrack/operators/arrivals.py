"""First and last detections, arrival summaries and the priority union."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.functions.times import elapsed


def first_per_tag(df: DataFrame, order=("ts", "seq")) -> DataFrame:
    """First row per tag. The filter runs before the shuffle too: one row per tag and task."""
    w = Window.partitionBy("tag").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_arrival(det: DataFrame, where: Column, name: str, unit: str = "days") -> DataFrame:
    """First detection per tag that meets ``where``, its date and the time since tagging."""
    return first_per_tag(det.where(where)).select(
        "tag",
        "sex",
        F.col("ts").cast("date").alias(f"{name}_date"),
        elapsed("ts", "tag_ts", unit).alias(f"{name}_{unit}"),
        "station",
        "tag_ts",
        "fork_length",
    )


def last_detection(det: DataFrame) -> DataFrame:
    """Last detection per tag; of several at that time the first in file order."""
    return first_per_tag(det, (F.desc_nulls_last("ts"), F.asc("seq")))


def last_detection_ties(det: DataFrame, by: str = "ts") -> DataFrame:
    """Every row at its tag's maximum of ``by``. Maximum by aggregation, rows by semi-join:
    many ties of one tag need not meet in one task."""
    last = det.groupBy("tag").agg(F.max(by).alias(by))
    return det.join(last, ["tag", by], "left_semi")


def first_times(targets=tuple(K.ARRIVALS)) -> dict[str, Column]:
    """Aggregates: the first time at each target."""
    return {
        f"{name}_ts": F.min(F.when(F.col(column) == value, F.col("ts")))
        for name, column, value, _ in targets
    }


def arrivals(det: DataFrame, targets=tuple(K.ARRIVALS)) -> DataFrame:
    """One row per detected tag with the first time at each target: one aggregation over fixed
    -width columns, combined map-side, in place of a sort and a join per target."""
    return det.groupBy("tag").agg(*[c.alias(n) for n, c in first_times(targets).items()])


def arrival_summary(det: DataFrame, tags: DataFrame, targets=tuple(K.ARRIVALS)) -> DataFrame:
    """One row per tag of the tag table: date of and time to each target (NULL if not reached)."""
    return summarise_arrivals(arrivals(det, targets), tags, targets)


def summarise_arrivals(
    first: DataFrame, tags: DataFrame, targets=tuple(K.ARRIVALS)
) -> DataFrame:
    """``arrival_summary`` from one row per tag with its first times."""
    columns = []
    for name, _, _, unit in targets:
        at = F.col(f"{name}_ts")
        columns.append(at.cast("date").alias(f"{name}_date"))
        columns.append(elapsed(at, "tag_ts", unit).alias(f"{name}_{unit}"))
    return tags.join(first, "tag", "left").select(
        "tag", "tag_ts", "sex", *columns, "fork_length"
    )


def arrival_timing_stats(summary: DataFrame, targets=tuple(K.ARRIVALS)) -> DataFrame:
    """Mean and sd of the times, mean of the dates, over tags that arrived."""
    columns = []
    for name, _, _, unit in targets:
        value = F.col(f"{name}_{unit}")
        mean_day = F.floor(F.avg(F.unix_date(f"{name}_date"))).cast("int")
        columns += [
            F.bround(F.avg(value), 1).alias(f"mean_{name}_{unit}"),
            F.bround(F.stddev_samp(value), 1).alias(f"sd_{name}_{unit}"),
            F.date_from_unix_date(mean_day).alias(f"mean_{name}_date"),
        ]
    return summary.agg(*columns)


def priority_union(sets: list[tuple[str, DataFrame]], order=("ts", "seq")) -> DataFrame:
    """Union of sets of tags, columns missing from a set filled with NULL; a tag found in
    several keeps its row of the first one."""
    parts = [
        df.withColumns({"source": F.lit(name), "_priority": F.lit(i)})
        for i, (name, df) in enumerate(sets)
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return first_per_tag(union, ("_priority", *order)).drop("_priority")


def claim(claims: list[tuple[str, Column, str]], micros_of: Column) -> tuple[Column, Column, Column]:
    """Of a row: the number and name of the first claim (name, condition, ``first`` or ``last``)
    it meets, and what orders the rows of that claim. NULL if it meets none."""
    number = name = place = None
    for i, (label, condition, which) in enumerate(claims):
        at = micros_of if which == "first" else -micros_of
        if number is None:
            number = F.when(condition, F.lit(i))
            name = F.when(condition, F.lit(label))
            place = F.when(condition, at)
        else:
            number = number.when(condition, F.lit(i))
            name = name.when(condition, F.lit(label))
            place = place.when(condition, at)
    return number, name, place


def first_claim(
    df: DataFrame, claims: list[tuple[str, Column, str]], micros_of: Column
) -> DataFrame:
    """``priority_union`` of sets that are all rows of ``df``, in one pass: one row per tag, from
    the first claim (name, condition, ``first`` or ``last``) that any of its rows meets. A row
    counts for the first claim it meets: if that one is not the tag's, neither is a later one.
    """
    number, name, place = claim(claims, micros_of)
    claimed = df.withColumns({"source": name, "_claim": number, "_place": place})
    first = first_per_tag(
        claimed.where(F.col("_claim").isNotNull()), ("_claim", "_place", "seq")
    )
    return first.drop("_claim", "_place")
