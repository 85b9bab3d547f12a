"""Entry maps of slices against the plain loop, for every start there may be."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivertrack.operators import speed
from rivertrack.operators.timeline import SLICE, is_sliced, slice_hot_tags

DAY = 86_400_000_000
LIMITS = (100.0, 100.0)


def loop(rows, start=None):
    """Rows kept, and the last of them."""
    kept, last = [], start
    for us, rkm in rows:
        if last is not None and speed._is_far(last, us, rkm, *LIMITS):
            continue
        kept.append((us, rkm))
        last = (us, rkm)
    return kept, last


def _rows(rng, n, step=DAY // 3):
    us, out = rng.randrange(DAY), []
    rkm = rng.choice([0.0, 50.0, 240.0])
    for _ in range(n):
        us += rng.choice([0, 0, step // 40, step // 4, step])
        if rng.random() < 0.5:
            rkm = rng.choice([0.0, 50.0, 99.0, 101.0, 150.0, 201.0, 240.0, 250.0, float("nan")])
        out.append((us, rkm))
    return out


def same(a, b):
    return a is b or (a is not None and b is not None and repr(a) == repr(b))


@pytest.mark.parametrize("seed", range(40))
def test_any_start_leaves_as_the_loop_does(seed):
    rng = random.Random(seed)
    rows = _rows(rng, rng.randrange(1, 60), rng.choice([DAY // 300, DAY // 3, DAY]))
    if seed % 5 == 0:  # without times at first
        rows = [(None, r) for _, r in rows[:3]] + rows[3:]
    entries = speed.EntryMap(0.0, 250.0, *LIMITS)
    for us, rkm in rows:
        entries.add(us, rkm)
    runs = entries.exits()
    assert len(runs) <= len(rows)
    began = next((us for us, _ in rows if us is not None), 0)
    assert same(speed.leave(None, runs, *LIMITS), loop(rows)[1])
    for back in (0, 1, DAY // 100, DAY // 2, DAY, 2 * DAY, 4 * DAY):
        for rkm in (0.0, 1.0, 50.0, 100.0, 149.0, 240.0, 250.0, float("nan")):
            start = (began - back, rkm)
            assert same(speed.leave(start, runs, *LIMITS), loop(rows, start)[1]), (start, rows)
    assert same(speed.leave((None, 3.0), runs, *LIMITS), loop(rows, (None, 3.0))[1])


def test_a_map_is_short_for_rows_at_stations():
    rows = [(i * 5_000_000, 42.0 if i % 1000 else 0.0) for i in range(100_000)]
    entries = speed.EntryMap(0.0, 42.0, *LIMITS)
    for us, rkm in rows:
        entries.add(us, rkm)
    assert entries.settled() and len(entries.exits()) == 1
    entries = speed.EntryMap(0.0, 250.0, *LIMITS)
    for us, rkm in rows:
        entries.add(us, rkm)
    assert entries.settled() and len(entries.exits()) < 100


@pytest.mark.parametrize("rows_per_slice", [3, 17, 200])
@pytest.mark.parametrize("seed", [1, 2])
def test_sliced_is_the_loop(spark, seed, rows_per_slice):
    rng = random.Random(seed)
    data, want = [], []
    for tag, n in (("a", 900), ("b", 400), ("c", 5)):
        rows = sorted(_rows(rng, n, rng.choice([DAY // 10, DAY])), key=lambda r: r[0])
        for i, (us, rkm) in enumerate(rows):
            ts = None if i % 97 == 5 and tag == "b" else datetime(2024, 1, 1) + timedelta(microseconds=us)
            data.append((tag, ts, 1000 * len(data) + i, None if rkm != rkm else rkm))
    for tag in "abc":
        mine = sorted((r for r in data if r[0] == tag), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        last = None
        for r in mine:
            us = None if r[1] is None else round((r[1] - datetime(2024, 1, 1)) / timedelta(microseconds=1))
            here = (us, float("nan") if r[3] is None else r[3])
            if last is None or not speed._is_far(last, *here, *LIMITS):
                want.append(r)
                last = here
    rng.shuffle(data)
    df = spark.createDataFrame(data, "tag string, ts timestamp_ntz, seq bigint, rkm double").repartition(5)
    cut = slice_hot_tags(df, rows_per_slice=rows_per_slice)
    assert is_sliced(cut)
    for d in (df, cut):
        got = speed.speed_filter(d, *LIMITS).drop(SLICE).collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert 0 < len(want) < len(data)


def test_two_passes_however_many_slices(spark, monkeypatch):
    """No loop on the driver: one count of the range of places, then the plan."""
    df = spark.range(3000).select(
        F.lit("a").alias("tag"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int))").alias("ts"),
        F.col("id").alias("seq"),
        (F.col("id") % 7 * 40.0).alias("rkm"),
    )
    cut = slice_hot_tags(df, rows_per_slice=10)
    calls = []
    monkeypatch.setattr(speed, "_fold", lambda d, *a, real=speed._fold: calls.append(d) or real(d, *a))
    out = speed.speed_filter(cut)
    assert len(calls) == 2  # the short tags, and the slices from their starts
    assert out.drop(SLICE).exceptAll(speed.speed_filter(df)).count() == 0
