"""Arrivals, counts, summaries and panels."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
import tracks
from pyspark.sql import functions as F

from rivertrack.functions.times import micros
from rivertrack.operators import arrivals, reports
from rivertrack.plans import movement
from rivertrack.plans.cascade import cleaning_cascade, unified_timeline, with_station_positions
from rivertrack.plans.maps import detection_history, last_detection_maps, survey_maps
from rivertrack.sources.files import write_stage

T0 = datetime(2024, 7, 4)


@pytest.fixture(scope="module")
def data():
    return tracks.detections(seed=7, hot=200, cold=30, tags=12)


@pytest.fixture(scope="module")
def det(spark, data):
    sex = F.element_at(
        F.array(F.lit("M"), F.lit("f"), F.lit(None).cast("string")),
        F.substring("tag", -3, 3).cast("int") % 3 + 1,
    )
    return (
        spark.createDataFrame(data, tracks.SCHEMA)
        .withColumn("sex", sex)
        .withColumn("fork_length", F.lit(55.0))
    )


@pytest.fixture(scope="module")
def tags(spark, det):
    extra = spark.createDataFrame(
        [("149.500 999", T0, "F", 50.0)],
        "tag STRING, tag_ts TIMESTAMP_NTZ, sex STRING, fork_length DOUBLE",
    )
    return det.select("tag", "tag_ts", "sex", "fork_length").distinct().unionByName(extra)


# --- median --------------------------------------------------------------------------------


@pytest.mark.parametrize("sketch", [{}, {"SKETCH_REACH": 0.5, "BRACKET_PARTS": 1}, {"SKETCH_SIZE": 8, "SKETCH_REACH": 0.4}])
def test_length_summary(spark, monkeypatch, sketch):
    for name, size in sketch.items():
        monkeypatch.setattr(reports, name, size)
    rng = random.Random(3)
    groups = {
        "M": [rng.gauss(55, 4) for _ in range(101)],
        "F": [round(rng.gauss(55, 4)) * 1.0 for _ in range(100)] + [55.0] * 300,  # many copies
        None: [48.0],
        "one value": [50.0] * 8,
        "none": [],
        **{f"{n} values": [rng.random() for _ in range(n)] for n in range(1, 12)},
        "with infinities": [float("-inf"), 1.0, 2.0, float("inf"), 3.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("M", None)]
    df = spark.createDataFrame(rows, "sex STRING, fork_length DOUBLE")
    got = {r.sex: r for r in reports.length_summary(df).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        r = got[g]
        assert r.n == len(vs) + (g in ("none", "M"))
        if not vs:
            assert (r.mean, r.median, r.min, r.max, r.sd) == (None,) * 5
            continue
        assert r.median == statistics.median(vs)
        assert (r.min, r.max) == (min(vs), max(vs))
        if g == "with infinities":
            continue
        assert r.mean == pytest.approx(statistics.fmean(vs))
        assert r.sd == (pytest.approx(statistics.stdev(vs)) if len(vs) > 1 else None)


def test_median_of_many(spark, tmp_path, monkeypatch):
    """Exact, from two scans of the values: one for the sketch, one for the bracket."""
    df = spark.range(300_000).selectExpr("id % 2 = 0 as sex", "pow(rand(7), 3) * 1e6 as fork_length", "id")
    nan = float("nan")
    df = df.withColumn("fork_length", F.when(~F.col("sex") & (F.col("id") % 3 > 0), F.lit(nan)).otherwise(F.col("fork_length")))
    df.drop("id").write.parquet(str(tmp_path / "lengths"))
    df = spark.read.parquet(str(tmp_path / "lengths"))
    written = []
    monkeypatch.setattr(reports, "write_stage", lambda d, path: written.append(d) or write_stage(d, path))
    out = reports.length_summary(df)
    got = {r.sex: r.median for r in out.collect()}
    want = sorted(r.fork_length for r in df.where("sex").collect())
    assert got[True] == (want[74_999] + want[75_000]) / 2
    assert math.isnan(got[False])  # two of three values are NaN
    plans = [d._jdf.queryExecution().sparkPlan().toString() for d in (*written, out)]
    assert [p.count("/lengths]") for p in plans] == [1, 1, 0]
    assert reports.write_stage(written[1], str(tmp_path / "again")).count() < 0.02 * 300_000


def test_a_bracket_that_misses_ends_the_run(spark, monkeypatch):
    monkeypatch.setattr(reports, "SKETCH_SIZE", 8)
    monkeypatch.setattr(reports, "SKETCH_REACH", 1e-6)
    df = spark.range(200_000).selectExpr("1 as sex", "rand(3) as fork_length")
    try:
        got = reports.length_summary(df).first().median
    except Exception as e:
        assert "missed the median" in str(e)
    else:
        assert got == df.agg(F.median("fork_length")).first()[0]


def test_length_histogram_edges(spark, rows):
    values = [45.9, 46.0, 46.5, 46.51, 47.5, 50.0, 66.0, 66.1, None]
    df = spark.createDataFrame([("M", v) for v in values], "sex STRING, fork_length DOUBLE")
    assert rows(reports.length_histogram(df)) == [
        ("Male", 46.0, 2),
        ("Male", 47.0, 2),
        ("Male", 50.0, 1),
        ("Male", 66.0, 1),
    ]


# --- counts --------------------------------------------------------------------------------


def test_false_positive_rate(spark, rows):
    det = spark.createDataFrame(
        [("a", "1", T0 + timedelta(1)), ("a", "1", T0 - timedelta(1)), ("b", "1", T0),
         ("b", "2", T0)],
        "tag STRING, station STRING, ts TIMESTAMP_NTZ",
    )
    tags = spark.createDataFrame([("a", T0)], "tag STRING, tag_ts TIMESTAMP_NTZ")
    got = {r[0]: r[1:] for r in rows(reports.false_positive_rate(det, tags))}
    assert got["1"] == (3, 1, pytest.approx(2 / 3))
    assert got["2"] == (1, 0, 1.0)


def test_detection_efficiency(det, data):
    got = {r.station: r for r in reports.detection_efficiency(det).collect()}
    at = {r[0] for r in data if r[4] == 42}
    up = {r[0] for r in data if r[4] >= 42}
    assert (got["2"].at_station, got["2"].at_or_upstream) == (len(at), len(up))
    at = {r[0] for r in data if r[4] == 214 and r[5] == "Nanika River"}
    up = {r[0] for r in data if r[4] >= 214 and r[5] == "Nanika River"}
    assert (got["4"].at_station, got["4"].at_or_upstream) == (len(at), len(up))


def test_efficiency_without_upstream_tags(spark):
    d = spark.createDataFrame([("a", 1.0, "z")], "tag STRING, rkm DOUBLE, zone STRING")
    got = reports.detection_efficiency(d, (("9", 500.0, None),)).first()
    assert (got.at_station, got.at_or_upstream, got.efficiency) == (0, 0, None)


def test_detected_and_undetected(det, tags, data, rows):
    got = reports.detected_counts(det, tags).first()
    seen = {r[0] for r in data}
    assert got.any == len(seen)
    assert got.mobile == len({r[0] for r in data if r[6] == "Mobile"})
    assert got.fixed == len({r[0] for r in data if r[6] != "Mobile"})
    assert (got.tags, got.undetected) == (len(seen) + 1, 1)
    assert rows(reports.undetected_tags(tags, det)) == [("149.500 999",)]


def test_multi_survey_tags(det, data):
    days = {}
    for r in data:
        if r[7] == "Mobile":
            days.setdefault(r[0], set()).add(r[3])
    want = {t: len(d) for t, d in days.items() if len(d) >= 3}
    got = {r.tag: r.surveys for r in reports.multi_survey_tags(det).collect()}
    assert got == want


def test_zone_presence_counts(det, data):
    got = {r.section: r for r in reports.zone_presence_counts(det, movement.sections()).collect()}
    want = {
        r[0]
        for r in data
        if r[6] == "2"
        or r[7] == "Mobile" and r[5] == "Bulkley River" and 42 <= r[4] <= 109
        or r[7] == "Mobile" and r[5] == "Morice River"
        or r[7] == "Mobile" and r[5] == "Bulkley River" and 0 <= r[4] <= 42
    }
    r = got["bulkley"]
    assert r.total == len(want) == r.male + r.female + r.unknown
    assert r.male == sum(int(t[-3:]) % 3 == 0 for t in want)
    assert r.female == sum(int(t[-3:]) % 3 == 1 for t in want)


# --- arrivals ------------------------------------------------------------------------------


def test_arrival_summary_agrees_with_first_arrivals(det, tags, rows):
    summary = arrivals.arrival_summary(det, tags)
    assert summary.columns == [
        "tag", "tag_ts", "sex", "fallback_date", "fallback_hours", "bulkley_date",
        "bulkley_days", "upper_bulkley_date", "upper_bulkley_days", "morice_lake_date",
        "morice_lake_days", "nanika_date", "nanika_days", "atna_date", "atna_days",
        "fork_length",
    ]
    assert summary.count() == tags.count()
    first = arrivals.first_arrival(det, F.col("station") == "1", "fallback", "hours")
    assert rows(first, "tag", "fallback_date", "fallback_hours") == rows(
        summary.where("fallback_date IS NOT NULL"), "tag", "fallback_date", "fallback_hours"
    )


def test_timing_stats(spark):
    summary = spark.createDataFrame(
        [(datetime(2024, 7, 5).date(), 1.0), (datetime(2024, 7, 8).date(), 2.5), (None, None)],
        "a_date DATE, a_days DOUBLE",
    )
    got = arrivals.arrival_timing_stats(summary, (("a", "zone", "A", "days"),)).first()
    assert (got.mean_a_days, got.sd_a_days) == (1.8, 1.1)
    assert got.mean_a_date == datetime(2024, 7, 6).date()


def test_last_detection_ties(spark, rows):
    d = spark.createDataFrame(
        [("a", T0, 3, "x"), ("a", T0, 2, "y"), ("a", T0 - timedelta(1), 1, "z"), ("b", T0, 9, "w")],
        "tag STRING, ts TIMESTAMP_NTZ, seq BIGINT, zone STRING",
    )
    assert rows(arrivals.last_detection(d), "tag", "zone") == [("a", "y"), ("b", "w")]
    assert rows(arrivals.last_detection_ties(d), "tag", "zone") == [
        ("a", "x"),
        ("a", "y"),
        ("b", "w"),
    ]


def test_priority_union_fills_and_ranks(spark, rows):
    one = spark.createDataFrame([("a", T0, 1)], "tag STRING, ts TIMESTAMP_NTZ, seq BIGINT")
    two = spark.createDataFrame(
        [("a", T0 - timedelta(1), 2, 5.0), ("b", T0, 3, 6.0)],
        "tag STRING, ts TIMESTAMP_NTZ, seq BIGINT, power DOUBLE",
    )
    got = rows(arrivals.priority_union([("one", one), ("two", two)]), "tag", "source", "power")
    assert got == [("a", "one", None), ("b", "two", 6.0)]


def test_first_claim_equals_priority_union(det, rows):
    a, b = F.col("rkm") > 210, F.col("zone").isin("Morice Lake", "Atna River")
    c, d = F.col("zone") == "Atna River", F.col("station") == "1"
    first = arrivals.first_per_tag
    want = arrivals.priority_union(
        [
            ("a", first(det.where(a))),
            ("b", first(arrivals.last_detection_ties(det.where(b)), ("seq",))),
            ("c", first(det.where(c))),
            ("d", first(det.where(d))),
        ]
    )
    got = arrivals.first_claim(
        det,
        [("a", a, "first"), ("b", b, "last"), ("c", c, "first"), ("d", d, "first")],
        micros("ts"),
    )
    assert {r.source for r in got.collect()} >= {"a", "b"}
    assert rows(got, *want.columns) == rows(want)


def test_movement_report_runs(det, tags):
    report = movement.movement_report(det, tags)
    assert {name: df.count() >= 0 for name, df in report.items()} == dict.fromkeys(report, True)
    fate = report["spawner_fate"]
    assert fate.count() == fate.select("tag").distinct().count()


# --- panels, unions, maps ------------------------------------------------------------------


def test_tag_pages(spark):
    keys = [f"149.{f} {c:03d}" for f in ("32", "320", "500") for c in range(1, 11)]
    df = spark.createDataFrame([(k,) for k in keys + keys], "tag STRING")
    got = {r.tag: (r.page, r.panel) for r in reports.tag_pages(df).collect()}
    assert got == {k: (i // 9 + 1, i % 9 + 1) for i, k in enumerate(sorted(keys))}
    many = spark.range(5000).selectExpr("concat('149.500 ', lpad(id, 5, '0')) as tag").repartition(7)
    pages = reports.tag_pages(many)
    assert "Window" not in pages._jdf.queryExecution().toString()
    ranked = [(r.page - 1) * 9 + r.panel for r in pages.orderBy("tag").collect()]
    assert ranked == list(range(1, 5001))
    assert reports.tag_pages(many.limit(0)).count() == 0
    numbers = [3, 9_999, 10_000, 25_000, 25_001, -4]
    df = spark.createDataFrame([(n,) for n in numbers], "tag BIGINT")
    got = {r.tag: (r.page, r.panel) for r in reports.tag_pages(df, per_page=2).collect()}
    assert got == {n: (i // 2 + 1, i % 2 + 1) for i, n in enumerate(sorted(numbers))}


def test_detection_history(det, data):
    out = detection_history(det)
    assert out.count() == len(data)  # all within the axis
    labels = {r[0] for r in out.select("location").distinct().collect()}
    assert "Fallback" in labels
    assert out.where("zone = 'Morice Lake' AND rkm <> 201").count() == 0


def test_unified_timeline_order(spark, det, tags, rows):
    fixed = with_station_positions(det.where("method = 'Fixed'"))
    out = unified_timeline(fixed, det.where("method = 'Mobile'"), tags)
    assert out.count() == det.count() + tags.count()
    at_once = out.where(F.col("tag") == "149.500 999").first()
    assert (at_once.method, at_once.rkm, at_once.lat) == ("Tagging", 0.0, None)
    cleaned = cleaning_cascade(out)
    assert cleaned.where("method = 'Tagging'").count() == tags.count()


def test_maps(det):
    placed = det.withColumns({"long": F.lit(-127.4250), "lat": F.lit(54.10783)})
    surveys = survey_maps(placed, dates=None)
    per_row = surveys.groupBy("seq").agg(F.collect_set("extent").alias("e")).first().e
    assert set(per_row) == {"Study area", "Morice River", "Morice Lake"} & set(per_row)
    assert "Study area" in per_row
    last = last_detection_maps(placed)
    assert last.select("tag").distinct().count() == det.select("tag").distinct().count()
