"""Tables clustered by tag: equal reports, no shuffle by tag, few files, long tags apart."""

import os

import pytest
import tracks
from pyspark.sql import functions as F

from rivertrack.operators import arrivals, reports
from rivertrack.operators.rules import RULES
from rivertrack.operators.timeline import SLICE, Clustered, cluster
from rivertrack.plans import cascade, movement
from rivertrack.schema import fixed_table



@pytest.fixture(scope="module")
def det(spark):
    rows = spark.createDataFrame(tracks.detections(seed=5), tracks.SCHEMA)
    return rows.withColumn("sex", F.when(F.crc32("tag") % 3 > 0, "m")).withColumn("fork_length", F.lit(50.0))


@pytest.fixture(scope="module")
def tags(spark, det):
    known = det.select("tag", "tag_ts", "sex", "fork_length").distinct()
    never = [("149.500 900", tracks.START, None, 49.0)]
    return known.unionByName(spark.createDataFrame(never, known.schema))


@pytest.fixture(scope="module", params=[2_000_000, 25])
def stage(request, det, tmp_path_factory):
    return cluster(det, str(tmp_path_factory.mktemp("clustered")), request.param, buckets=4)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_rows_and_files(stage, det, rows):
    assert rows(stage.rows(), *det.columns) == rows(det)
    folder = stage.short.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) <= 4
    if stage.long is not None:
        assert {r.tag for r in stage.long.select("tag").distinct().collect()} == {"149.500 001"}
        assert SLICE in stage.long.columns and SLICE not in stage.short.columns


def test_neither_cascade_nor_facts_shuffle_short_tags(spark, stage):
    early = fixed_table(spark, [("early", "149.500 002", None, None, None, None, None)], RULES)
    cleaned = cascade.cleaning_cascade(Clustered(stage.short), early)
    assert [x for x in _exchanges(cleaned) if "BroadcastExchange" not in x] == []
    # writing them as they lie needs none either
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lies = cluster(stage.short, f"{stage.short.inputFiles()[0].rsplit('/', 2)[0]}/again", buckets=n)
    assert [x for x in _exchanges(cascade.cleaning_cascade(lies).repartition(n, "tag"))] == []
    assert _exchanges(movement.tag_facts(Clustered(lies.short))) == []


def test_cleaned_rows_are_those_of_the_plain_cascade(stage, det, rows, tmp_path):
    cleaned = cascade.clean_clustered(stage, str(tmp_path))
    plain = cascade.cleaning_cascade(det, rows_per_slice=None)
    assert rows(cleaned.rows(), *plain.columns) == rows(plain)


def test_report_is_that_of_one_scan_per_table(stage, det, tags, rows):
    got = movement.movement_report(stage, tags)
    here = movement.present(det)
    summary = arrivals.arrival_summary(det, tags)
    want = {
        "arrival_summary": summary,
        "arrival_timing_stats": arrivals.arrival_timing_stats(summary),
        "detection_efficiency": reports.detection_efficiency(det),
        "detected_counts": reports.detected_counts(here, tags),
        "undetected_tags": reports.undetected_tags(tags, here),
        "multi_survey_tags": reports.multi_survey_tags(det),
        "zone_presence_counts": reports.zone_presence_counts(here, movement.sections()),
        "spawner_fate": movement.spawner_fate(det),
    }
    assert got.keys() == want.keys()
    for name, df in want.items():
        assert rows(got[name], *df.columns) == rows(df), name
    assert rows(got["undetected_tags"]) == [("149.500 900",)]
    for name, df in got.items():  # each reads the facts, none the detections
        files = {f.rsplit("/", 2)[-2] for f in df.inputFiles() if "clustered" in f}
        assert files == set(), name
