"""Points written by place: neighbours lie together, a window on the map reads a part of the files."""

import random

import pytest
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.operators import spatial

BOX = (("all", 0.0, 100.0, 0.0, 100.0), ("inset", 20.0, 30.0, 60.0, 70.0), ("edge", 100.0, 120.0, -5.0, 100.0))


def interleaved(x, y):
    bits = [int(min(max(c / 100, 0.0), 1.0) * 65535) for c in (x, y)]
    return sum(((bits[k] >> i) & 1) << (2 * i + k) for i in range(16) for k in (0, 1))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(6)
    rows = [(i, rng.uniform(-10, 110), rng.uniform(-10, 110)) for i in range(20_000)]
    rows += [(20_000 + i, 25.0, 65.0) for i in range(5_000)]  # a place with many rows
    rows += [(30_000, None, 3.0), (30_001, 100.0, 100.0), (30_002, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "seq bigint, x double, y double")


def test_place_key(spark, points):
    some = points.where("seq % 50 = 0 and x is not null").select("x", "y", spatial.place_key(BOX[:1]).alias("k"))
    for r in some.collect():
        assert r.k == interleaved(r.x, r.y)
    assert points.where("seq = 30000").select(spatial.place_key(BOX)).first()[0] is None


def _rows_scanned(df):
    """(rows that leave the scan, rows of the answer), after running it."""
    df = df.select("seq", "x", "y")
    n = len(df.collect())
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    if "Adaptive" in leaf.nodeName():
        leaf = leaf.executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value(), n


def test_windows_are_those_of_the_membership(spark, points, rows, tmp_path):
    stage = spatial.write_by_place(points, str(tmp_path / "p"), BOX, files=32)
    assert stage.columns == points.columns and stage.count() == points.count()
    every = spatial.bbox_membership(points, BOX)
    for name, *_ in BOX:
        got = spatial.in_extent(stage, name, BOX)
        assert rows(got, "seq", "x", "y", "extent") == rows(every.where(F.col("extent") == name), "seq", "x", "y", "extent")


def test_a_window_reads_a_part(spark, points, tmp_path):
    even = points.where("seq < 20000")
    stage = spatial.write_by_place(even, str(tmp_path / "p"), BOX, files=32)
    read, n = _rows_scanned(spatial.in_extent(stage, "inset", BOX))
    assert 0 < n <= read < 0.2 * 20_000
    plain = even.repartition(32)
    plain.write.parquet(str(tmp_path / "plain"))
    read, _ = _rows_scanned(spatial.in_extent(spark.read.parquet(str(tmp_path / "plain")), "inset", BOX))
    assert read == 20_000


def test_a_crowded_place_is_dealt_over_files(spark, points, tmp_path):
    stage = spatial.write_by_place(points.where("seq >= 20000 and seq < 30000"), str(tmp_path / "p"), BOX, files=8)
    sizes = [r["count"] for r in stage.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2_000


def test_study_extents_are_all_inside_the_key(spark):
    boxes = {name: e for name, *e in K.MAP_EXTENTS}
    corners = [(0, e[i], e[j]) for e in boxes.values() for i in (0, 1) for j in (2, 3)]
    df = spark.createDataFrame(corners, "seq bigint, x double, y double").distinct()
    assert df.select(spatial.place_key()).distinct().count() == df.count()
