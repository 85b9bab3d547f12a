"""Integer clustering against brute force, with ties, repeats, odd vectors and large numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from rivertrack.llm import centroids as C

SCHEMA = "vec_id bigint, embedding array<double>, id string, vector string, v string, cluster int"


def brute(rows, clusters=C.CLUSTERS, rounds=C.ROUNDS):
    kept = [
        (i, [math.floor(x * 256) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]

    def drawn(row):
        i, v = row
        return (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), v)

    middle = [v for _, v in sorted(kept, key=drawn)[:clusters]]

    def assigned():
        def far(v, c):
            return sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

        return [min((far(v, c), k) for k, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        of = [k for _, k in assigned()]
        for k in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == k]
            middle[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, k, d) for (i, _), (d, k) in zip(kept, assigned(), strict=True)), key=repr), middle


def _rows(n, seed, scale=1.0, coarse=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(0, 0.13) * scale for _ in range(64)]
        if coarse:  # few different values: many equal distances
            v = [rng.choice([0.0, 0.0, 0.004]) for _ in range(64)]
        out.append((i, v))
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "i", "v", "w", 7) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("coarse", [False, True])
def test_equals_brute_force(spark, coarse):
    rows = _rows(300, 5, coarse=coarse)
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, rows[5][1]), (7, rows[8][1])]  # repeats, no id, one id twice
    bad = list(rows[0][1])
    rows += [(900, None), (901, []), (902, bad[:63]), (903, [None, *bad[1:]]), (904, [float("nan"), *bad[1:]])]
    rows += [(905, [float("-inf"), *bad[1:]]), (906, [*bad, 0.0])]
    found, middle = C.cluster(_frame(spark, rows))
    want, want_middle = brute(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert middle == want_middle
    full = C.clusters_with_inertia(_frame(spark, rows)).collect()
    assert {r.inertia for r in full} == {sum(d for *_, d in want)}
    for r in full:
        assert r.cluster_inertia == sum(d for _, k, d in want if k == r.cluster)
        said = ",".join(map(str, want_middle[r.cluster]))
        assert r.centroid_sha256 == hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("scale", [1e6, 1e7])
def test_large_numbers_stay_exact(spark, scale):
    rows = _rows(60, 9, scale)
    found, middle = C.cluster(_frame(spark, rows))
    want, want_middle = brute(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want and middle == want_middle


def test_a_distance_beyond_64_bits_is_null(spark):
    rows = [*_rows(200, 3), (1000, [1e15] * 64), (1001, [-1e15] * 64), (1002, [1.0, *[-1e15] * 63])]
    got = {r.id: r for r in C.cluster(_frame(spark, rows))[0].collect()}
    want, _ = brute(rows)
    assert all(got[i].cluster == k and got[i].distance == (d if d < 2**63 else None) for i, k, d in want)
    assert None in {r.distance for r in got.values()}
    assert {r.inertia for r in C.clusters_with_inertia(_frame(spark, rows)).collect()} == {None}


def test_few_vectors_and_none(spark):
    rows = _rows(3, 1)
    assert [r.distance for r in C.cluster(_frame(spark, rows))[0].collect()] == [0, 0, 0]
    assert C.clusters_with_inertia(_frame(spark, [])).count() == 0
    assert C.clusters_with_inertia(_frame(spark, [(1, None)])).count() == 0


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (500, 64))
    c = rng.integers(-300, 300, (40, 64))
    axes = C.Axes(v)
    (lead, rest), (c_lead, c_rest) = axes.turn(v), axes.turn(c)
    bound = ((lead[:, None] - c_lead) ** 2).sum(axis=2) + (rest[:, None] - c_rest) ** 2
    exact = ((v[:, None] - c) ** 2).sum(axis=2)
    assert (bound <= exact * (1 + 1e-9)).all()
    at, best = C.nearest(v, lead, rest, c, axes)
    assert (at == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
