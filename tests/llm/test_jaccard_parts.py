"""Parts of sets: two that link share a named part, whatever the threshold and the size."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivertrack.llm import jaccard_join as J
from rivertrack.llm.common import clustered


def _linked_pair(rng, n, percent):
    """Two sets that just link, and how they differ."""
    base = rng.integers(0, 2**63, 3 * n + 40, dtype=np.uint64)
    base = np.unique(base)
    rng.shuffle(base)
    m = int(rng.integers(n, 100 * n // percent + 1))
    both = -(-percent * (n + m) // (100 + percent))
    if both > n:
        return None
    x = np.sort(base[:n])
    y = np.sort(np.concatenate([base[:both], base[n : n + m - both]]))
    return (x, y) if 100 * both >= percent * (n + m - both) else None


@pytest.mark.parametrize("percent", [50, 80, 90, 95, 99])
def test_sets_that_link_share_a_named_part(percent):
    rng = np.random.default_rng(percent)
    tried = 0
    for n in [*range(1, 130), 250, 1000, 5000]:
        for _ in range(6):
            pair = _linked_pair(rng, n, percent)
            if pair is None or np.array_equal(*pair):
                continue
            tried += 1
            a, b = (set(J.signatures(s, percent).tolist()) for s in pair)
            assert a & b, (n, [len(s) for s in pair])
    assert tried > 100 or percent > 98


def test_sets_with_empty_parts_meet(monkeypatch):
    """As few spare parts as none: then empty parts are named and met."""
    monkeypatch.setattr(J, "parts_of", lambda level, percent, real=J.parts_of: (lambda c: c and (c[0] - c[1], 0))(real(level, percent)))
    rng = np.random.default_rng(1)
    for n in range(2, 60):
        for _ in range(20):
            pair = _linked_pair(rng, n, 60)
            if pair is not None:
                a, b = (set(J.signatures(s, 60).tolist()) for s in pair)
                assert a & b, n


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_sets_that_link_share_a_list_that_neither_leaves(percent):
    """Whatever lists are longest: those that the two share are, or those of one order of names."""
    rng = np.random.default_rng(percent + 1)
    left = 0
    for n in [*range(1, 130), 250, 1000, 5000]:
        for _ in range(6):
            pair = _linked_pair(rng, n, percent)
            if pair is None or np.array_equal(*pair):
                continue
            names = [J.signatures(s, percent).tolist() for s in pair]
            shared = set(names[0]) & set(names[1])
            for order in (lambda t: (t not in shared, t), lambda t: t):
                kept = []
                for s, of in zip(pair, names, strict=True):
                    spare = J.spared(s, percent)
                    ranked = [sorted((t for t in of if t % 2 == odd), key=order) for odd in (0, 1)]
                    kept.append({t for odd in (0, 1) for t in ranked[odd][spare[odd] :]})
                    left += sum(spare)
                assert kept[0] & kept[1], (n, [len(s) for s in pair])
    assert left


def test_sets_with_a_few_parts_in_common_meet_in_no_list(spark):
    """200 texts of one length with a sixth of their words in common: at 80 percent, some of their many
    small parts are equal in dozens of them, but too few for any two to link."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(16)]
    texts = [" ".join([*common, *(f"w{rng.random()}" for _ in range(80))]) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = [J.signatures(J.shingles(t, 5), 80).tolist() for t in texts]
    assert max(Counter(t for of in names for t in of).values()) > 10
    members = J.summarise(docs, percent=80, words=5)
    classes = members.withColumn("key", F.monotonically_increasing_id())
    index = clustered(J.postings(docs, percent=80, words=5), "jaccard-index", ("token",), ("hi",))
    assert J.shared_lists(index, classes).count() == 0


def test_levels_hold_all_sizes_that_link():
    for percent in (50, 80, 90, 99):
        lows = J.levels(percent)
        for n in [*range(1, 400), 12_345, 10**6, 10**9]:
            m = 100 * n // percent
            a, b = np.searchsorted(lows, [n, m], "right") - 1
            assert 0 <= b - a <= 1


def test_texts_with_a_common_passage_rarely_meet():
    """A third of each text is the same, nothing else."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(100)]
    names = [J.signatures(J.shingles(" ".join([*passage, *(f"w{rng.random()}" for _ in range(200))])), 90) for _ in range(60)]
    met = {t for s in names for t in set(s.tolist())}
    assert len(met) >= sum(map(len, names)) - 5


def test_nothing_links_at_a_hundred_percent():
    assert len(J.signatures(np.arange(50, dtype=np.uint64), 100)) == 0


def test_a_worker_remembers_a_bounded_number_of_words():
    J._words.clear()
    text = " ".join(f"word{i}" for i in range(150_000))
    first = J.shingles(text)
    assert len(J._words) <= 100_000
    assert np.array_equal(first, J.shingles(text))


def test_texts_go_to_python_in_short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c e")], "doc_id bigint, text string")
        assert J.jaccard_components(docs).count() == 2
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
