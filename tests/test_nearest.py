"""The packed tree and both ways to the nearest point against brute force, ties included."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivertrack.operators import nearest, spatial
from rivertrack.plans import mobile
from rivertrack.workload.queries import QUERIES

POINTS = "idx bigint, x double, y double, name string"


def brute(px, py, x, y):
    far = np.sqrt((x[:, None] - px) ** 2 + (y[:, None] - py) ** 2)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 3000])
@pytest.mark.parametrize("kind", ["spread", "lattice", "clumps", "line", "one place"])
def test_tree_is_brute_force(n, kind):
    rng = np.random.default_rng(n)
    px, py = rng.uniform(0, 100, (2, n))
    if kind == "lattice":  # many equal distances, also from both sides of a box's border
        px, py = np.floor(px / 10), np.floor(py / 10)
    elif kind == "clumps":
        px, py = px**5 / 1e8, np.where(py > 50, py, 1e9 + py)
    elif kind == "line":
        py = np.full(n, 7.0)
    elif kind == "one place":
        px, py = np.full(n, 3.0), np.full(n, 4.0)
    tree = nearest.PackedTree(px, py)
    x, y = rng.uniform(-50, 150, (2, 700))
    x[:300], y[:300] = np.floor(x[:300] / 5) / 2, np.floor(y[:300] / 5) / 2
    at, dist = tree.nearest(x, y)
    want, far = brute(px, py, x, y)
    assert (at == want).all() and (dist == far).all()
    who, place = tree.within(x, y, far * 1.5)
    near = np.sqrt((x[:, None] - px) ** 2 + (y[:, None] - py) ** 2) <= (far * 1.5)[:, None]
    assert sorted(zip(who.tolist(), place.tolist())) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_comparisons_grow_with_the_logarithm():
    rng = np.random.default_rng(1)
    for n in (1_000, 30_000, 1_000_000):
        tree = nearest.PackedTree(*rng.uniform(0, 1e5, (2, n)))
        tree.nearest(*rng.uniform(0, 1e5, (2, 2000)))
        assert tree.compared / 2000 < 20 * math.log2(n)


@pytest.fixture(scope="module")
def layer():
    rng = random.Random(3)
    points = [(i, float(rng.randrange(40)), float(rng.randrange(40)), f"p{i}") for i in range(900)]
    points += [(900 + i, 1e6 + rng.random(), 5.0, "far") for i in range(300)]  # dense, and far off
    points += [(1200 + i, 20.0, 20.0, "same") for i in range(200)]
    rng.shuffle(points)
    dets = [(i, rng.randrange(90) / 2, rng.randrange(90) / 2) for i in range(1500)]
    dets += [(1500 + i, 1e6 + rng.random(), 5.0 + rng.random()) for i in range(200)]
    dets += [(1700, -5e7, 3e7), (1701, None, 2.0), (1702, float("nan"), 1.0), (1703, 1.0, float("-inf"))]
    return points, dets + dets[:40]


@pytest.mark.parametrize("way", ["tree", "leaves", "small leaves, small groups"])
def test_both_ways_are_brute_force(spark, layer, monkeypatch, way):
    points, dets = layer
    if way.endswith("groups"):
        monkeypatch.setattr(nearest, "POSITIONS_PER_GROUP", 7)
    options = {"tree": {}, "leaves": {"max_points": 5, "per_leaf": 100}}.get(way, {"max_points": 5, "per_leaf": 4})
    p = spark.createDataFrame([*points, (5000, None, 1.0, "no"), (5001, float("nan"), 1.0, "no")], POINTS)
    d = spark.createDataFrame(dets, "id bigint, x double, y double").repartition(5)
    got = spatial.nearest_reference_point(d, p, **options).collect()
    ranked = sorted(points)
    px, py = (np.array([q[k] for q in ranked]) for k in (1, 2))
    here = [t for t in dets if t[1] is not None and math.isfinite(t[1]) and math.isfinite(t[2])]
    at, far = brute(px, py, *(np.array([t[k] for t in here]) for k in (1, 2)))
    want = [(t[0], ranked[a][0], f, ranked[a][3]) for t, a, f in zip(here, at.tolist(), far.tolist())]
    want += [(t[0], None, None, None) for t in dets if t not in here]
    assert sorted(((r.id, r.idx, r.dist, r.name) for r in got), key=repr) == sorted(want, key=repr)


def test_leaves_are_bounded(spark, layer):
    p = spark.createDataFrame(layer[0], POINTS).select("idx", "x", "y")
    sizes = nearest.packed_leaves(p, 50).groupBy("leaf").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50
    assert sizes.agg(F.sum("count")).first()[0] == len(layer[0])
    assert sizes.count() < 3 * len(layer[0]) / 50


def test_projection_is_computed_once_and_rows_stay(spark):
    """No copy of the projection in a filter, no second scan, no code too large to generate."""
    points = spark.createDataFrame([(i, 6e5 + 1000 * i, 6e6, "p") for i in range(9)], POINTS)
    srx = spark.range(100).selectExpr(
        "id as seq", "-127D + id / 100 as long", "54D as lat", "'t' as tag",
        "timestamp_ntz'2024-01-02' + make_dt_interval(0, 0, cast(id as int)) as ts"
    )
    tags = spark.sql("select 't' as tag, timestamp_ntz'2024-01-01' as tag_ts, 'M' as sex, 1D as fork_length")
    out = mobile.mobile_pipeline(srx, tags, points, order=("seq",)).where("x > 0 and dist < 1e7")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # of the latitude (here a constant), of the longitude, and one per term of the series
    assert plan.count("SIN(") <= 6 and plan.count("Range") == 1
    assert out.count() == 100


@pytest.mark.parametrize("name", ["mobile_pipeline", "survey_map_jitter", "cleaning_cascade", "scan_srx", "fixed_study"])
def test_code_is_generated(spark, name):
    """No stage falls out of whole-stage code generation."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    assert stages.size() > 0
    for i in range(stages.size()):
        code = stages.apply(i)
        assert 0 < code._3().maxMethodCodeSize() < 64 * 1024, code._1()[:500]
