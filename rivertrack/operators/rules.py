"""Curated exclusion rules as data: a tag with optional station, rkm, methods and time range."""

import csv
from datetime import datetime
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrack.functions.keys import normalise_key
from rivertrack.functions.times import MICROS_PER_SECOND, micros
from rivertrack.schema import fixed_table

RULES = (
    "step STRING, tag STRING, station STRING, rkm DOUBLE, methods ARRAY<STRING>, "
    "ts_from TIMESTAMP_NTZ, ts_to TIMESTAMP_NTZ"
)
_FILE = files("rivertrack") / "data" / "exclusion_rules.csv"


def study_rules(spark: SparkSession, *steps: str) -> DataFrame:
    """The study's own rules (``early``, ``lost_tag``, ``odd``), keys in canonical form."""

    def when(text):
        return datetime.fromisoformat(text) if text else None

    lines = [x for x in _FILE.read_text("utf-8").splitlines() if not x.startswith("#")]
    rows = [
        (
            r["step"],
            r["tag"],
            r["station"] or None,
            float(r["rkm"]) if r["rkm"] else None,
            r["methods"].split("|") if r["methods"] else None,
            when(r["ts_from"]),
            when(r["ts_to"]),
        )
        for r in csv.DictReader(lines)
        if not steps or r["step"] in steps
    ]
    rules = fixed_table(spark, rows, RULES)
    return rules.withColumn("tag", normalise_key("tag"))


def _matches(d: str, r: str):
    """A rule's condition; a term the rule leaves NULL matches anything."""

    def col(side, name):
        return F.col(f"{side}.{name}")

    def term(name, test):
        return col(r, name).isNull() | test

    return (
        (col(d, "tag") == col(r, "tag"))
        & term("station", col(d, "station") == col(r, "station"))
        & term("rkm", col(d, "rkm") == col(r, "rkm"))
        & term("methods", F.array_contains(col(r, "methods"), col(d, "method")))
        & term("ts_from", col(d, "ts") >= col(r, "ts_from"))
        & term("ts_to", col(d, "ts") <= col(r, "ts_to"))
    )


def exclude(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop the rows that any rule matches.

    An anti join on the tag. A hand-written rule table is small, so Catalyst broadcasts it; a
    larger one falls back to a shuffled join by itself, as no hint is given.
    """
    return df.alias("d").join(rules.alias("r"), _matches("d", "r"), "left_anti")


def _timed(rules: DataFrame) -> DataFrame:
    """The rules with both ends of a time range, as often as they reach into bins: ``level`` n
    has bins of 2^n seconds, at least as wide as the rule, so that it reaches into two."""
    start, end = micros("ts_from"), micros("ts_to")
    seconds = F.greatest((end - start) / float(MICROS_PER_SECOND), F.lit(1.0))
    bins = F.sequence(_bin("ts_from", F.col("level")), _bin("ts_to", F.col("level")))
    return (
        rules.where("ts_from <= ts_to")
        .withColumn("level", F.ceil(F.log2(seconds)).cast("int"))
        .withColumn("bin", F.explode(bins))
    )


def _bin(ts, level) -> Column:
    return F.floor(micros(ts) / (F.pow(F.lit(2.0), level) * MICROS_PER_SECOND))


def _open(rules: DataFrame) -> DataFrame:
    """The rules without one end or both, the widest of each that say the same otherwise."""
    same = rules.where("ts_from IS NULL OR ts_to IS NULL").withColumn(
        "methods", F.array_sort("methods")
    )
    starts, ends = F.col("ts_from").isNotNull(), F.col("ts_to").isNotNull()
    widest = same.groupBy("tag", "station", "rkm", "methods", starts.alias("s"), ends.alias("e"))
    return widest.agg(F.min("ts_from").alias("ts_from"), F.max("ts_to").alias("ts_to"))


def exclude_by_time(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``exclude`` for rule tables in which a tag may have very many rules.

    A row meets only the rules near it in time: rules with a time range are joined on tag and
    time bin, one join for each width of bins that the rules call for, and each of them lies in
    two bins or so. Rules open at an end cannot be binned, but of those that differ in their time
    alone only the widest counts. The widths, at most some forty, are read while the plan is made.
    """
    timed = _timed(rules)
    out = exclude(df, _open(rules))
    for (level,) in sorted(timed.select("level").distinct().collect()):
        placed = out.withColumn("_bin", _bin("ts", F.lit(level))).alias("d")
        near = timed.where(F.col("level") == level).alias("r")
        same_bin = F.col("d._bin") == F.col("r.bin")
        out = placed.join(near, same_bin & _matches("d", "r"), "left_anti").drop("_bin")
    return out


def subsumed_rules(rules: DataFrame) -> DataFrame:
    """Rules another rule of the same tag makes redundant: its every term is wider or equal."""
    a, b = rules.alias("a"), rules.alias("b")

    def wider(name, test):
        return F.col(f"b.{name}").isNull() | F.coalesce(test, F.lit(False))

    same = F.lit(True)
    for name in ("station", "rkm", "methods", "ts_from", "ts_to"):
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    return a.join(
        b,
        (F.col("a.tag") == F.col("b.tag"))
        & wider("station", F.col("a.station") == F.col("b.station"))
        & wider("rkm", F.col("a.rkm") == F.col("b.rkm"))
        & wider("methods", F.size(F.array_except("a.methods", "b.methods")) == 0)
        & wider("ts_from", F.col("a.ts_from") >= F.col("b.ts_from"))
        & wider("ts_to", F.col("a.ts_to") <= F.col("b.ts_to"))
        & ~same,
        "left_semi",
    )
