"""A tag's timeline: rows of one tag in (ts, seq) order, and how to keep one tag from filling
one task.

Most tags are short, and a window over ``tag`` is the cheapest plan: one shuffle serves every
operator in a chain. A tag lying beside a receiver, though, may hold a third of all rows.
``slice_hot_tags`` looks for such tags once and cuts only their timelines into slices, in a
``slice`` column that is NULL for every other tag. Operators that find the column partition
their windows by (tag, slice) and carry the little they need from one slice to the next: one
row per slice, so at most a few rows per ``rows_per_slice`` detections. Filters only make
slices smaller, so the column stays valid down a chain of operators.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivertrack.functions.times import micros
from rivertrack.schema import fixed_table
from rivertrack.session import shared_dir
from rivertrack.sources.files import write_clustered, write_stage

SLICE = "slice"
# a slice number holds up to six cuts of 10 bits each, the coarsest first
_CUTS, _CUT_BITS = 6, 10


def is_sliced(df: DataFrame) -> bool:
    return SLICE in df.columns


def hot_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(SLICE).isNotNull())


def timeline_keys(df: DataFrame) -> list[str]:
    return ["tag", SLICE] if is_sliced(df) else ["tag"]


def timeline(df: DataFrame, *more: str) -> WindowSpec:
    """The tag's rows in order (within its slice, if sliced)."""
    return Window.partitionBy(*timeline_keys(df), *more).orderBy("ts", "seq")


def slice_hot_tags(
    df: DataFrame, rows_per_slice: int = 2_000_000, max_cuts: int = 50_000
) -> DataFrame:
    """Add ``slice`` to the rows of tags with more than ``rows_per_slice`` rows.

    Counts rows per tag (an aggregation that reads one column) and returns ``df`` unchanged
    when no tag is that long. Otherwise a long tag is cut evenly over its time span, slices still
    too full are cut again, and rows that share one instant are cut by ``seq``. The table of
    cuts reaches the driver and the executors, so ``rows_per_slice`` is raised until it has at
    most ``max_cuts`` rows. These counts are jobs that run while the plan is made, as do the rounds
    of ``speed_filter`` on slices and the reading of a reference layer.
    """
    spark, tag_type = df.sparkSession, df.schema["tag"].dataType

    def over_limit(counts: DataFrame) -> list:
        nonlocal rows_per_slice
        while True:
            found = counts.where(F.col("n") > rows_per_slice).limit(max_cuts + 1).collect()
            if len(found) <= max_cuts:
                return found
            rows_per_slice *= 4

    known = df.where(F.col("tag").isNotNull())
    long_tags = over_limit(known.groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
    if not long_tags:
        return df
    # so that all slices together stay within a small multiple of max_cuts
    rows_per_slice = max(rows_per_slice, -(-sum(r.n for r in long_tags) // max_cuts))

    tag_table = T.StructType([T.StructField("tag", tag_type)])
    long_table = F.broadcast(fixed_table(spark, [(r.tag,) for r in long_tags], tag_table))
    schema = T.StructType(
        [
            T.StructField("_tag", tag_type),
            T.StructField("_slice", T.LongType()),
            T.StructField("_by_seq", T.BooleanType()),
            T.StructField("_timeless", T.BooleanType()),
            T.StructField("_lo", T.LongType()),
            T.StructField("_width", T.LongType()),
        ]
    )
    time, seq = micros("ts"), F.col("seq").cast("bigint")
    out = df.withColumn(SLICE, F.lit(None).cast("bigint"))
    for level in range(_CUTS):
        rows = out.join(long_table, "tag", "left_semi") if level == 0 else hot_rows(out)
        too_full = over_limit(
            rows.groupBy("tag", SLICE).agg(
                F.count(F.lit(1)).alias("n"),
                F.min(time).alias("t0"),
                F.max(time).alias("t1"),
                F.min(seq).alias("s0"),
                F.max(seq).alias("s1"),
            )
        )
        if not too_full:
            if level == 0:
                return df
            break
        cuts = []
        for r in too_full:
            by_seq = r.t0 == r.t1
            lo, hi = (r.s0, r.s1) if by_seq else (r.t0, r.t1)
            parts = min(-(-r.n // rows_per_slice), 2**_CUT_BITS - 1)
            cuts.append((r.tag, r[SLICE], by_seq, r.t0 is None, lo, -(-(hi - lo + 1) // parts)))
        # rows without a time come first in a timeline, so they stay in the first of the new
        # slices; where no row has one, seq alone orders them
        ordered = F.col("ts").isNotNull() | F.col("_timeless")
        at = F.when(F.col("_by_seq"), F.when(ordered, seq)).otherwise(time)
        place = F.lit(2 ** (_CUT_BITS * (_CUTS - 1 - level)))
        cut = F.floor((at - F.col("_lo")) / F.col("_width"))
        step = F.coalesce(cut, F.lit(0)) * place
        out = (
            out.join(
                F.broadcast(fixed_table(spark, cuts, schema)),
                (F.col("tag") == F.col("_tag")) & F.col(SLICE).eqNullSafe(F.col("_slice")),
                "left",
            )
            .withColumn(
                SLICE,
                F.when(
                    F.col("_width").isNotNull(), F.coalesce(F.col(SLICE), F.lit(0)) + step
                ).otherwise(F.col(SLICE)),
            )
            .drop(*schema.names)
        )
    return out


def unslice(df: DataFrame) -> DataFrame:
    return df.drop(SLICE)


@dataclass(frozen=True)
class Clustered:
    """A table of detections in two parts: ``short``, whose rows lie in files by tag, and
    ``long``, the sliced rows of very long tags (None if there are none). A tag is in one part
    only, so whatever works tag by tag works on the parts side by side."""

    short: DataFrame
    long: DataFrame | None = None

    def per_tag(self, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``step`` on both parts; its results must have the same columns."""
        out = step(self.short)
        return out if self.long is None else out.unionByName(step(self.long))

    def rows(self) -> DataFrame:
        return self.per_tag(unslice)


def cluster(
    df: DataFrame, path: str, rows_per_slice: int = 2_000_000, buckets: int | None = None
) -> Clustered:
    """Write detections clustered by tag (see ``files.write_clustered``). Very long tags would
    each fill a file, so theirs are written apart, as they come, with their slices. ``df`` is read
    once to find them; give it from stage tables."""
    cut = slice_hot_tags(df, rows_per_slice)
    if not is_sliced(cut):
        return Clustered(write_clustered(df, f"{path}/short", buckets=buckets))
    short = unslice(cut.where(F.col(SLICE).isNull()))
    return Clustered(
        write_clustered(short, f"{path}/short", buckets=buckets),
        write_stage(hot_rows(cut), f"{path}/long"),
    )


def settle(df: DataFrame) -> DataFrame:
    """Between steps on a sliced timeline: write it to the checkpoint folder, since each step
    reads its input once for the rows and once for what slices pass on. Nothing to do on an
    unsliced one, where a whole chain is one shuffle."""
    if not is_sliced(df):
        return df
    shared_dir(df.sparkSession)
    return df.checkpoint()


def previous(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add, for each ``name: column``, that column's value in the tag's preceding row."""
    w = timeline(df)
    if not is_sliced(df):
        # plain columns, so that nothing extra is shuffled
        return df.withColumns({n: F.lag(c).over(w) for n, c in columns.items()})
    row = F.struct(*columns.values())
    # last row of each slice, handed to the next slice of the tag that has rows
    tails = (
        hot_rows(df)
        .groupBy("tag", SLICE)
        .agg(F.max_by(row, F.struct("ts", "seq")).alias("_tail"))
    )
    carried = F.lag("_tail").over(Window.partitionBy("tag").orderBy(SLICE))
    carry = F.broadcast(tails.withColumn("_carry", carried).drop("_tail"))
    out = (
        df.withColumn("_prev", F.lag(row).over(w))
        .join(carry, ["tag", SLICE], "left")
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
    )
    return out.select(
        *df.columns, *[F.col(f"_prev.{c}").alias(n) for n, c in columns.items()]
    )


def first_where(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Add the (ts, seq) of the tag's first row that meets ``condition``; NULL if none does."""
    here = F.when(condition, F.struct("ts", "seq"))
    if not is_sliced(df):
        return df.withColumn(name, F.min(here).over(Window.partitionBy("tag")))
    # long tags: aggregate map-side first; at most one row per long tag comes back
    met = hot_rows(df).where(condition)
    first = met.groupBy("tag").agg(F.min(F.struct("ts", "seq")).alias("_of_long"))
    short = F.min(here).over(Window.partitionBy("tag", SLICE))
    return (
        df.withColumn(name, short)
        .join(F.broadcast(first), "tag", "left")
        .withColumn(name, F.when(F.col(SLICE).isNull(), F.col(name)).otherwise(F.col("_of_long")))
        .select(*df.columns, name)
    )
