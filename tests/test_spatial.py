"""Projection, nearest point, extents, jitter."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rivertrack.operators import nearest, spatial
from rivertrack.plans import maps
from rivertrack.plans.mobile import mobile_rkm


def snyder(long, lat):
    """The older power-series form of the same projection, good to millimetres near its axis."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, dl = math.radians(lat), math.radians(long + 129)
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi)
        - 35 * e2**3 / 3072 * math.sin(6 * phi)
    )
    p = dl * math.cos(phi)
    x = p + (1 - t + c) * p**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * p**5 / 120
    y = (
        p**2 / 2
        + (5 - t + 9 * c + 4 * c * c) * p**4 / 24
        + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * p**6 / 720
    )
    return 500000 + k0 * n * x, k0 * (m + n * math.tan(phi) * y)


@pytest.mark.parametrize(
    "long, lat", [(-129, 0), (-127.3189, 55.01835), (-127.74321, 54.014545), (-130.9, 48.2)]
)
def test_projection(spark, long, lat):
    place = spark.range(1).select(F.lit(float(long)).alias("long"), F.lit(float(lat)).alias("lat"))
    r = spatial.project_utm(place).first()
    assert (r.x, r.y) == pytest.approx(snyder(long, lat), abs=0.01)


@pytest.fixture(scope="module")
def cloud():
    rng = random.Random(5)
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100), float(i), "z") for i in range(150)]
    points.append((150, points[3][1], points[3][2], 150.0, "copy of 3"))
    dets = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(300)]
    dets += [(300, 5000.0, -7000.0), (301, points[3][1], points[3][2]), (302, None, 1.0)]
    return points, dets


@pytest.mark.parametrize("way", ["in task", "by leaf", "by small leaf"])
def test_nearest(spark, cloud, way):
    points, dets = cloud
    p = spark.createDataFrame(points, "idx BIGINT, x DOUBLE, y DOUBLE, rkm DOUBLE, zone STRING")
    d = spark.createDataFrame(dets, "det_id BIGINT, x DOUBLE, y DOUBLE")
    options = {
        "in task": {},
        "by leaf": {"max_points": 10},
        "by small leaf": {"max_points": 10, "per_leaf": 3},
    }[way]
    got = {r.det_id: r for r in spatial.nearest_reference_point(d, p, **options).collect()}
    assert len(got) == len(dets)
    for i, x, y in dets:
        if x is None:
            assert got[i].idx is None and got[i].rkm is None
            continue
        dist, idx = min((math.sqrt((x - q[1]) ** 2 + (y - q[2]) ** 2), q[0]) for q in points)
        assert got[i].idx == idx
        assert got[i].rkm == float(idx)
        assert got[i].dist == pytest.approx(dist)


def test_nearest_tie_takes_lowest_index(spark):
    p = spark.createDataFrame(
        [(7, 1.0, 0.0), (2, -1.0, 0.0), (9, 0.0, 1.0)], "idx BIGINT, x DOUBLE, y DOUBLE"
    )
    d = spark.createDataFrame([(1, 0.0, 0.0)], "det_id BIGINT, x DOUBLE, y DOUBLE")
    assert spatial.nearest_reference_point(d, p).first().idx == 2
    assert spatial.nearest_reference_point(d, p, max_points=1).first().idx == 2


@pytest.mark.parametrize("way", [{}, {"max_points": 1}], ids=["in task", "by leaf"])
def test_nearest_repeated_ids_and_bad_positions(spark, way):
    p = spark.createDataFrame(
        [(0, 0.0, 0.0), (2, 10.0, 0.0), (5, float("nan"), 0.0)], "idx INT, x DOUBLE, y DOUBLE"
    )
    nan, inf = float("nan"), float("inf")
    d = spark.createDataFrame(
        [(1, 1.0, 0.0), (1, 9.0, 0.0), (1, 9.0, 0.0), (2, nan, 0.0), (3, 0.0, inf), (4, None, 0.0)],
        "det_id BIGINT, x DOUBLE, y DOUBLE",
    )
    out = spatial.nearest_reference_point(d, p, **way)
    assert out.schema["idx"].dataType.simpleString() == "int"
    got = sorted((r.det_id, r.idx if r.idx is not None else -1) for r in out.collect())
    assert got == [(1, 0), (1, 2), (1, 2), (2, -1), (3, -1), (4, -1)]


def test_mobile_rkm(spark):
    p = spatial.project_utm(
        spark.createDataFrame(
            [(1, -127.0, 54.5, 10.0, "A"), (2, -127.1, 54.5, 11.0, "B")],
            "idx BIGINT, long DOUBLE, lat DOUBLE, rkm DOUBLE, zone STRING",
        )
    ).drop("long", "lat")
    d = spark.createDataFrame([(5, -127.09, 54.51)], "seq BIGINT, long DOUBLE, lat DOUBLE")
    assert (lambda r: (r.rkm, r.zone))(mobile_rkm(d, p).first()) == (11.0, "B")


def test_bbox_borders(spark, rows):
    d = spark.createDataFrame(
        [(0.0, 0.0), (1.0, 1.0), (1.1, 0.0), (None, 0.0)], "x DOUBLE, y DOUBLE"
    )
    boxes = (("a", 0.0, 1.0, 0.0, 1.0), ("b", 1.0, 2.0, 0.0, 2.0))
    assert rows(spatial.bbox_membership(d, boxes)) == [
        (0.0, 0.0, "a"),
        (1.0, 1.0, "a"),
        (1.0, 1.0, "b"),
        (1.1, 0.0, "b"),
    ]


def test_jitter(spark):
    d = spark.range(2000).selectExpr("id AS seq", "0D AS x", "9D AS y")
    j = spatial.jitter_points(d, 500.0)
    r = j.agg(
        F.min("x_jitter").alias("lo"), F.max("x_jitter").alias("hi"), F.avg("x_jitter").alias("m"),
        F.max(F.abs(F.col("y_jitter") - 9)).alias("y"),
    ).first()
    assert -500 <= r.lo < -480 and 480 < r.hi <= 500 and abs(r.m) < 30 and r.y <= 500
    again = spatial.jitter_points(d.repartition(5), 500.0)
    assert again.exceptAll(j).count() == 0


def test_survey_slices(spark, rows):
    d = spark.createDataFrame(
        [(1, "2023-08-30", "Mobile"), (2, "2023-09-06", "Mobile"), (3, "2023-09-07", "Mobile"),
         (4, "2023-09-06", "Fixed")],
        "seq INT, date STRING, method STRING",
    ).withColumn("date", F.col("date").cast("date"))
    assert rows(spatial.survey_slices(d), "seq", "survey") == [(1, 1), (2, 2), (3, 3)]
    picked = spatial.survey_slices(d, ["2023-08-30", "2023-09-06"])
    assert rows(picked, "seq", "survey") == [(1, 1), (2, 2)]


def test_vertex_filter_reaches_the_attribute_scan(spark):
    base = "/root/testdata/sf0.001"
    v = spark.read.parquet(f"{base}/lineitem.parquet").selectExpr("l_orderkey AS id", "l_quantity")
    a = spark.read.parquet(f"{base}/orders.parquet").selectExpr("o_orderkey AS id", "o_orderstatus")
    out = spatial.vertex_attribute_join(v, a, F.col("o_orderstatus") == "F")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_map_layers(spark, rows):
    vertices = spark.createDataFrame(
        [(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (2, 1, 5.0, 5.0), (3, 1, 9.0, 9.0)],
        "id INT, `order` INT, long DOUBLE, lat DOUBLE",
    )
    attributes = spark.createDataFrame(
        [(1, 3, "highway", "A"), (2, 2, "arterial", None), (3, None, "track", "C")],
        "id INT, STRMRDR INT, ROAD_CLASS STRING, GNSNM1 STRING",
    )
    assert rows(maps.map_streams(vertices, attributes), "id", "order") == [(1, 1), (1, 2)]
    assert rows(maps.map_roads(vertices, attributes), "id", "order") == [(1, 1), (1, 2), (2, 1)]
    assert rows(maps.map_lakes(vertices, attributes), "id", "order") == [(1, 1), (1, 2), (3, 1)]


def test_fixed_station_points(spark, tmp_path):
    path = tmp_path / "places.csv"
    path.write_text("Station,Latitude,Longitude\n1,55.01835,-127.3189\n")
    r = maps.fixed_station_points(spark, str(path)).first()
    assert (r.station, r.lat, r.long) == ("1", 55.01835, -127.3189)
    assert (r.x, r.y) == pytest.approx(snyder(-127.3189, 55.01835), abs=0.01)
