"""Rules joined by time bins drop the rows that the plain anti join drops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.operators import rules as R
from rivertrack.plans import maps

START = datetime(2024, 7, 1)


def _at(rng):
    return START + timedelta(seconds=rng.randrange(0, 5_000_000), microseconds=rng.choice([0, 0, 1, 999_999]))


def test_equal_to_the_plain_anti_join(spark, rows):
    rng = random.Random(8)
    det = [
        (rng.choice(["a", "b", "c", None]), rng.choice([_at(rng), None]) if i % 9 == 0 else _at(rng), i,
         rng.choice(["1", "2", None]), rng.choice([1.0, 2.0, None]), rng.choice(["Fixed", "Mobile", "Tagging"]))
        for i in range(4000)
    ]
    times = [r[1] for r in det if r[1]]
    table = []
    for _ in range(400):
        start = rng.choice([None, rng.choice(times), _at(rng)])
        length = timedelta(seconds=rng.choice([0, 0, 1, 64, 65, 4000, 300_000, -10]))
        end = rng.choice([None, _at(rng), start and start + length, start])
        methods = rng.choice([None, ["Fixed"], ["Mobile", "Fixed"], ["Fixed", "Mobile"]])
        tag = rng.choice(["a", "b"]) if start and end else "d"
        table.append(("s", tag, rng.choice([None, "1", "2"]), rng.choice([None, 2.0]), methods, start, end))
    table += [("s", "c", "1", None, ["Mobile"], None, _at(rng)) for _ in range(3)]
    table += [("s", "c", "2", 1.0, None, _at(rng), None) for _ in range(3)] + [("s", "b", "1", 1.0, ["Tagging"], None, None)]
    det = spark.createDataFrame(det, "tag string, ts timestamp_ntz, seq bigint, station string, rkm double, method string")
    table = spark.createDataFrame(table, R.RULES)
    want = rows(R.exclude(det, table))
    got = R.exclude_by_time(det, table)
    assert got.columns == det.columns and rows(got) == want
    assert 0 < len(want) < 4000
    assert rows(R.exclude_by_time(det, table.limit(0))) == rows(det)
    assert rows(R.exclude_by_time(det, R.study_rules(spark))) == rows(det)


def test_a_rule_lies_in_few_bins_and_meets_few_rows(spark):
    """One tag with a rule and a row for each of 3,000 hours."""
    hours = spark.range(3000).select(
        F.lit("s").alias("step"),
        F.lit("a").alias("tag"),
        F.lit(None).cast("string").alias("station"),
        F.lit(None).cast("double").alias("rkm"),
        F.lit(None).cast("array<string>").alias("methods"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("ts_from"),
        F.expr("timestamp_ntz'2024-01-01 00:10:00' + make_dt_interval(0, cast(id as int))").alias("ts_to"),
    )
    timed = R._timed(hours)
    assert timed.groupBy("ts_from").count().agg(F.max("count")).first()[0] <= 2
    assert [r[0] for r in timed.select("level").distinct().collect()] == [10]
    det = hours.select("tag", (F.expr("ts_from + interval 3 minutes")).alias("ts"), "station", "rkm", F.lit("Fixed").alias("method"))
    pairs = det.withColumn("_bin", R._bin("ts", F.lit(10))).join(timed, F.expr("_bin = bin"))
    assert pairs.count() < 3 * 3000
    assert R.exclude_by_time(det, hours).count() == 0


def test_jitter_by_survey(spark):
    days = [(d, i) for i, d in enumerate(K.SURVEY_DATES)]
    det = spark.createDataFrame(days, "day string, n int").withColumn("date", F.to_date("day"))
    got = {r.day: r.m for r in det.select("day", maps.survey_jitter().alias("m")).collect()}
    assert got == {d: 2000.0 if d == "2023-09-26" else 500.0 for d in K.SURVEY_DATES}
    assert {r.m for r in det.select(maps.survey_jitter(7.0, {}).alias("m")).collect()} == {7.0}
