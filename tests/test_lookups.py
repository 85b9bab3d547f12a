"""Keys, times, metadata adapters, lookups and rules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.functions.keys import normalise_key, pad_two_digit_code, tag_key
from rivertrack.functions.times import elapsed, micros, parse_date, parse_ts, seconds_between
from rivertrack.operators import lookups, rules
from rivertrack.operators.cleaning import dedup_keep_first
from rivertrack.plans.mobile import mobile_raw
from rivertrack.schema import TAG_METADATA_2023, TAG_METADATA_2024
from rivertrack.sources.files import null_tokens


def test_tag_key(spark, rows):
    d = spark.createDataFrame(
        [("149.5", 1), ("149.50", 19), ("149.48", 199), ("149.500", 1234), (None, 1), ("1", None)],
        "f STRING, c INT",
    )
    got = [r[0] for r in d.select(tag_key(F.col("f").cast("decimal(6,3)"), "c")).collect()]
    assert got == ["149.500 001", "149.500 019", "149.480 199", "149.500 1234", None, None]


def test_normalise_key(spark):
    d = spark.createDataFrame(
        [("149.48 41",), ("149.420 002",), ("149.48 3?",), ("149.48 NA",), ("149.5 7",)],
        "k STRING",
    )
    got = [tuple(r) for r in d.select(normalise_key("k"), pad_two_digit_code("k")).collect()]
    assert got == [
        ("149.480 041", "149.48 041"),
        ("149.420 002", "149.420 002"),
        ("149.48 3?", "149.48 3?"),
        ("149.48 NA", "149.48 NA"),
        ("149.500 007", "149.5 7"),
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/Vancouver", "Asia/Kolkata"])
def test_times_do_not_depend_on_session_zone(spark, zone):
    # the clock change of 2024-03-10 in Vancouver must not show
    d = spark.createDataFrame(
        [(datetime(2024, 3, 10, 1, 59, 59, 100000), datetime(2024, 3, 10, 3, 0, 5))],
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ",
    )
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        r = d.select(seconds_between("b", "a").alias("s"), micros("a").alias("u")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r.s == pytest.approx(3605.9)
    assert r.u == 1710035999100000


def test_elapsed_rounds_half_to_even(spark):
    t = datetime(2024, 7, 1)
    d = spark.createDataFrame(
        [
            (t, datetime(2024, 7, 3, 12)),  # 2.5 days
            (t, datetime(2024, 7, 4, 12)),  # 3.5 days
            (t, datetime(2024, 7, 1, 0, 15)),  # 0.25 hours
        ],
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ",
    )
    got = d.select(elapsed("b", "a", "days"), elapsed("b", "a", "hours")).collect()
    assert [r[0] for r in got] == [2.0, 4.0, 0.0]
    assert got[2][1] == 0.2


def test_parsing_failures_are_null(spark):
    d = spark.createDataFrame([("2024-07-05",), ("2024-13-05",), ("x",)], "t STRING")
    got = d.select(parse_date("t").cast("string"), parse_ts("t").cast("string")).collect()
    assert [tuple(r) for r in got] == [
        ("2024-07-05", "2024-07-05 00:00:00"),
        (None, None),
        (None, None),
    ]


def _metadata(spark, ddl, values, tokens):
    raw = spark.createDataFrame(values, ddl)
    return null_tokens(raw.withColumn("seq", F.monotonically_increasing_id()), tokens)


def test_tags_2024(spark, rows):
    raw = _metadata(
        spark,
        TAG_METADATA_2024,
        [
            ("2024-07-10", "500", "1", "m", "55.5"),
            ("2024-07-11", "500", "1", "f", "50"),  # second row of a tag
            ("2024-07-12", "unkn", "19", "F", "NA"),  # frequency known by number
            ("NA", "500", "13", "", "60"),  # date known by number
            ("", "320", "14", "M", "61"),  # no date: left out
            ("2024-07-12", "320", "3?", "M", "61"),  # no usable number
        ],
        K.NA_TOKENS_2024,
    )
    got = rows(lookups.tags_2024(raw), "tag", "tag_ts", "sex", "fork_length")
    assert got == [
        ("149.500 001", datetime(2024, 7, 10), "M", 55.5),
        ("149.500 013", datetime(2024, 7, 12), None, 60.0),
        ("149.500 019", datetime(2024, 7, 12), "F", None),
    ]


def test_tags_2023(spark, rows):
    raw = _metadata(
        spark,
        TAG_METADATA_2023,
        [
            ("7/10/2023", "09:15", "48", "41", "m", "55"),  # recaptured
            ("7/9/2023", "08:00", "48", "41", "m", "55"),
            ("7/9/2023", "08:10", "48", "3?", "f", "56"),
            ("7/9/2023", "08:10", "42", "unknown", "f", "56"),
            ("07/09/2023", "08:20", "42", "7", "unknown", "57.5"),
        ],
        K.NA_TOKENS_2023,
    )
    got = rows(lookups.tags_2023(raw), "tag", "tag_ts", "sex", "fork_length")
    assert got == [
        ("149.420 007", datetime(2023, 7, 9, 8, 20), None, 57.5),
        ("149.480 041", datetime(2023, 7, 9, 8, 0), "M", 55.0),
    ]


def test_tagging_events(spark):
    tags = spark.createDataFrame(
        [("149.500 001", datetime(2024, 7, 10, 9), "M", 55.0)],
        "tag STRING, tag_ts TIMESTAMP_NTZ, sex STRING, fork_length DOUBLE",
    )
    r = lookups.tagging_events(tags).first()
    assert (r.ts, r.rkm, r.zone, r.method, r.station, r.power) == (
        datetime(2024, 7, 10, 9), 0.0, "Tagging", "Tagging", "Tagging", None,
    )


def test_station_lookup_and_quarantine(spark, rows):
    d = spark.createDataFrame([("1",), ("6",), ("9",)], "station STRING")
    known, unknown = lookups.split_unknown_stations(lookups.station_lookup(d))
    assert rows(known, "station", "zone", "rkm") == [
        ("1", "Bulkley River", -0.7),
        ("6", "Morice Lake", 201.0),
    ]
    assert rows(unknown, "station") == [("9",)]


def test_channels(spark, rows):
    d = spark.createDataFrame([(1, 19), (2, 7), (3, 7), (4, 7)], "channel INT, code INT")
    assert rows(mobile_raw(d), "channel", "frequency", "tag") == [
        (1, "149.500", "149.500 019"),
        (2, "149.320", "149.320 007"),
        (3, "149.340", "149.340 007"),
        (4, "other", None),
    ]


def test_tag_join_keeps_many_to_many(spark, rows):
    t = datetime(2024, 7, 10)
    det = spark.createDataFrame(
        [("a", datetime(2024, 7, 11), 1), ("a", t, 2), ("b", t, 3)],
        "tag STRING, ts TIMESTAMP_NTZ, seq BIGINT",
    )
    tags = spark.createDataFrame(
        [("a", t), ("a", datetime(2024, 7, 1)), ("c", t)], "tag STRING, tag_ts TIMESTAMP_NTZ"
    )
    assert len(rows(lookups.detection_tag_join(det, tags))) == 4
    assert rows(lookups.after_tagging(det, tags), "seq") == [(1,), (1,), (2,)]


def test_reject_error_records(spark, rows):
    d = spark.createDataFrame([("12",), ("999",), ("of",), (None,)], "code STRING")
    good, bad = lookups.reject_error_records(d)
    assert rows(good) == [("12",)]
    assert rows(bad) == [("999",), ("of",), (None,)] or len(rows(bad)) == 3


def test_dedup_of_a_hot_group_is_filtered_before_the_shuffle(spark):
    d = spark.range(10).selectExpr("id % 2 AS tag", "id % 2 AS ts", "id AS seq")
    plan = dedup_keep_first(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange")
    partial = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in partial


# --- rules ---------------------------------------------------------------------------------


def test_study_rules(spark):
    all_rules = rules.study_rules(spark)
    assert all_rules.count() == 115
    steps = all_rules.groupBy("step").agg(F.count("*").alias("n"))
    assert {r.step: r.n for r in steps.collect()} == {"early": 4, "lost_tag": 21, "odd": 90}
    assert all_rules.where(~F.col("tag").rlike(r"^149\.\d{3} \d{3}$")).count() == 0


def test_subsumed_rules(spark, rows):
    got = rows(rules.subsumed_rules(rules.study_rules(spark, "lost_tag")), "tag")
    assert [g[0] for g in got] == ["149.420 068", "149.420 077", "149.420 100", "149.420 150"]


def test_exclude(spark, rows):
    t = datetime(2023, 9, 13, 16, 7, 59)
    det = spark.createDataFrame(
        [
            (1, "149.420 001", "1", -0.7, "Fixed", t),
            (2, "149.420 001", "1", -0.7, "Lost Tag", t),  # method not in the rule
            (3, "149.420 001", "1", -0.7, "Fixed", datetime(2023, 9, 13, 16, 7, 58)),
            (4, "149.420 002", "Mobile", 10.0, "Mobile", datetime(2023, 7, 1)),
            (5, "149.480 041", "1", -0.7, "Fixed", datetime(2023, 8, 3, 13, 15, 54)),
            (6, "149.480 041", "1", None, "Fixed", datetime(2023, 8, 3, 13, 15, 54)),
            (7, "149.500 001", "1", -0.7, "Fixed", t),
        ],
        "id INT, tag STRING, station STRING, rkm DOUBLE, method STRING, ts TIMESTAMP_NTZ",
    )
    kept = rules.exclude(det, rules.study_rules(spark, "lost_tag", "odd"))
    assert [r[0] for r in rows(kept, "id")] == [2, 3, 6, 7]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # chosen by size, not by a hint
