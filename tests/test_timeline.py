"""Timeline operators: long tags cut into slices give what a plain window gives, and both give
what a loop over each tag's rows gives."""

import pytest
import tracks
from pyspark.sql import functions as F

from rivertrack.operators import cleaning, speed
from rivertrack.operators.lookups import detection_tag_join
from rivertrack.operators.timeline import SLICE, hot_rows, is_sliced, previous, slice_hot_tags
from rivertrack.plans.cascade import cleaning_cascade

LIMIT = 25


@pytest.fixture(scope="module")
def data():
    return tracks.detections()


@pytest.fixture(scope="module")
def det(spark, data):
    return spark.createDataFrame(data, tracks.SCHEMA)


@pytest.fixture(scope="module")
def sliced(det):
    return slice_hot_tags(det, rows_per_slice=LIMIT)


def test_only_long_tags_are_cut(sliced, data):
    hot = hot_rows(sliced)
    assert {r.tag for r in hot.select("tag").distinct().collect()} == {"149.500 001"}
    assert sliced.count() == len(data)


def test_slices_are_bounded_and_in_order(sliced):
    groups = (
        hot_rows(sliced)
        .groupBy(SLICE)
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("ts", "seq")).alias("lo"),
            F.max(F.struct("ts", "seq")).alias("hi"),
        )
        .orderBy(SLICE)
        .collect()
    )
    assert max(g.n for g in groups) <= LIMIT
    assert all(a.hi < b.lo for a, b in zip(groups, groups[1:]))


def test_nothing_to_cut(det):
    assert not is_sliced(slice_hot_tags(det, rows_per_slice=10_000))


def test_cut_table_stays_within_bound(det):
    few = slice_hot_tags(det, rows_per_slice=5, max_cuts=2)
    assert hot_rows(few).select("tag").distinct().count() <= 2


OPERATORS = {
    "previous": lambda d: previous(d, {"p_rkm": "rkm", "p_power": "power"}),
    "detection_lag": cleaning.detection_lag,
    "min_gap_filter": cleaning.min_gap_filter,
    "lost_tag_flag": cleaning.lost_tag_flag,
    "gap_gate": cleaning.gap_gate,
    "terminal_zone_lock": lambda d: cleaning.terminal_zone_lock(d, "Nanika River"),
    "reach_flag_cumsum": lambda d: cleaning.reach_flag_cumsum(d, "Atna River"),
    "movement_rates": cleaning.movement_rates,
    "impossible_moves": cleaning.impossible_moves,
    "speed_filter": speed.speed_filter,
    "strongest_mobile": lambda d: cleaning.strongest_mobile(d, clustered=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_sliced_equals_plain(rows, det, sliced, name):
    plain = rows(OPERATORS[name](det))
    cut = OPERATORS[name](sliced).drop(SLICE)
    assert rows(cut, *OPERATORS[name](det).columns) == plain


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_without_time_stay_in_their_timeline(rows, det, name):
    """They come first, sliced or not, also where all of a tag's times are missing."""
    some = det.withColumn("ts", F.when(F.col("seq") % 7 != 0, F.col("ts")))
    for d in (some, det.withColumn("ts", F.lit(None).cast(det.schema["ts"].dataType))):
        cut = slice_hot_tags(d, rows_per_slice=LIMIT)
        assert is_sliced(cut)
        assert rows(OPERATORS[name](cut).drop(SLICE)) == rows(OPERATORS[name](d))


def test_lost_tags(rows, det, sliced, data):
    want = {}
    for tag, track in tracks.timelines(data).items():
        hits = [
            b[1] for a, b in zip(track, track[1:]) if (b[1] - a[1]).total_seconds() == 13
        ]
        if hits:
            want[tag] = min(hits)
    for d in (det, sliced):
        assert {r[0]: r[2] for r in rows(cleaning.lost_tags(d))} == want


def test_strongest_mobile_forms_agree(rows, det):
    plain = rows(cleaning.strongest_mobile(det))
    assert plain == rows(cleaning.strongest_mobile(det, clustered=True))


def test_min_gap_against_loop(rows, det, data):
    want = []
    for track in tracks.timelines(data).values():
        last = None
        for r in track:
            if last is None or (r[1] - last).total_seconds() >= 5:
                want.append(r[2])
            last = r[1]  # the previous raw row, kept or not
    assert sorted(r[0] for r in rows(cleaning.min_gap_filter(det), "seq")) == sorted(want)


def remove_one_by_one(track, max_distance=100.0, max_rate=100.0):
    """Drop the first impossible move, start again, until there is none."""
    track = list(track)
    while True:
        for i in range(1, len(track)):
            days = (track[i][1] - track[i - 1][1]).total_seconds() / 86400
            distance = abs(track[i][4] - track[i - 1][4])
            if distance > max_distance and distance > days * max_rate:
                del track[i]
                break
        else:
            return track


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_speed_filter_against_naive_loop(spark, rows, seed):
    data = tracks.detections(seed, hot=250, cold=20)
    d = spark.createDataFrame(data, tracks.SCHEMA)
    want = sorted(
        r[2] for track in tracks.timelines(data).values() for r in remove_one_by_one(track)
    )
    assert sorted(r[0] for r in rows(speed.speed_filter(d), "seq")) == want
    cut = slice_hot_tags(d, rows_per_slice=30)
    assert is_sliced(cut)
    assert sorted(r[0] for r in rows(speed.speed_filter(cut), "seq")) == want


def test_speed_filter_where_folds_never_meet(spark, rows):
    """Two places an impossible move apart, in turn: the start of every slice matters."""
    data = [
        (f"149.500 {tag:03d}", tracks.START + tracks.timedelta(seconds=i), tag * 1000 + i,
         tracks.START.date(), 200.0 * ((i // 3 + i) % 2), "z", "1", "Fixed", 1.0, tracks.START)
        for tag in (1, 2)
        for i in range(120)
    ]
    d = spark.createDataFrame(data, tracks.SCHEMA)
    want = sorted(
        r[2] for track in tracks.timelines(data).values() for r in remove_one_by_one(track)
    )
    cut = slice_hot_tags(d, rows_per_slice=10)
    assert sorted(r[0] for r in rows(speed.speed_filter(cut), "seq")) == want


def test_speed_filter_leaves_nothing_to_detect(det):
    kept = speed.speed_filter(det)
    assert cleaning.impossible_moves(kept).count() == 0
    assert speed.speed_filter(kept).count() == kept.count()


def test_null_rkm_is_kept_by_speed_filter(spark, rows):
    t = tracks.START
    s = tracks.timedelta(seconds=60)
    data = [("a", t, 1, 0.0), ("a", t + s, 2, None), ("a", t + 2 * s, 3, 200.0)]
    d = spark.createDataFrame(data, "tag STRING, ts TIMESTAMP_NTZ, seq BIGINT, rkm DOUBLE")
    assert [r[0] for r in rows(speed.speed_filter(d), "seq")] == [1, 2, 3]


def test_terminal_lock_equals_running_sum(rows, det):
    zone = "Nanika River"
    flagged = cleaning.reach_flag_cumsum(det, zone)
    literal = flagged.where(~((F.col("reached") == 1) & (F.col("zone") != zone)))
    assert rows(literal.select(det.columns)) == rows(cleaning.terminal_zone_lock(det, zone))


def test_cascade_sliced_equals_plain(rows, det):
    plain = cleaning_cascade(det, remove_impossible=True)
    cut = cleaning_cascade(det, remove_impossible=True, rows_per_slice=LIMIT)
    assert rows(cut, *plain.columns) == rows(plain)


def test_input_order_does_not_matter(spark, rows, data):
    one = spark.createDataFrame(data, tracks.SCHEMA)
    other = spark.createDataFrame(data[::-1], tracks.SCHEMA).repartition(7)
    assert rows(cleaning_cascade(one)) == rows(cleaning_cascade(other))


def test_salted_tag_join_equals_plain(spark, rows, det, sliced):
    tags = spark.createDataFrame(
        [(f"149.500 {i:03d}", tracks.START, s) for i in range(1, 5) for s in "ab"[: 1 + i % 2]],
        "tag STRING, tag_ts TIMESTAMP_NTZ, sex STRING",
    )
    plain = detection_tag_join(det.drop("tag_ts"), tags)
    cut = detection_tag_join(sliced.drop("tag_ts"), tags, salts=5)
    assert rows(cut, *plain.columns) == rows(plain)


def test_whole_cascade_is_one_shuffle(det):
    plan = cleaning_cascade(det)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
