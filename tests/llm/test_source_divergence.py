"""Differences of sources against plain Python: nulls, empty groups, tiles, cells, long texts."""

import random
import re
from collections import Counter

import pytest

from rivertrack.llm import source_divergence as S

DOCS = "doc_id bigint, text string, lang string, source string, term string, count bigint, number bigint"


def _rows():
    rng = random.Random(4)
    words = ["the", "The", "ÉTÉ", "été", "über", "naïve", "x1y", "don't", "日本", "zulu", "alpha", "beta"]
    out = []
    for i in range(260):
        lang = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice(["a", "b", "c", "d", "é", None, ""])
        text = " ".join(rng.choices(words, weights=range(1, 13), k=rng.randrange(1, 40)))
        out.append((i, text, lang, source, "t", 1, 2))
    out += [out[0], out[0], (None, None, "en", "a", "t", 1, 2), (900, "", "xx", "only", "t", 1, 2)]
    out += [(901, "1 2 3 _ -", "en", "no terms", "t", 1, 2), (902, "rare words", "yy", "p", "t", 1, 2)]
    return [*out, (903, "other rare", "yy", "q", "t", 1, 2)]


def brute(rows, min_docs, most):
    docs = [
        (r[2] or "", r[3] or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))))
        for r in rows
    ]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, c in mine for t in c)
        kept = sorted(t for t, n in df.items() if n >= min_docs)

        def shares(group):
            count = Counter()
            for *_, c in group:
                count.update(c)
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}, count

        q, _ = shares(mine)
        by = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for source, (p, count) in by.items():
            pair = [(-sum(abs(p[t] - o[t]) for t in kept), s.encode()) for s, (o, _) in by.items() if s != source]
            term = [(q[t] - p[t], t.encode()) for t in kept if count[t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:most])):
                out += [(lang, source, part, item.decode(), -v, n) for n, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile, cell_rows, min_docs", [(512, 100_000, 30), (2, 5, 30), (3, 1, 2), (1, 7, 10**6)])
def test_equals_plain_python(spark, monkeypatch, tile, cell_rows, min_docs):
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "CELL_ROWS", cell_rows)
    rows = _rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(tuple(r) for r in S.divergence(docs, min_docs=min_docs, most_terms=3).collect())
    assert got == brute(rows, min_docs, 3)


def test_no_rows(spark):
    assert S.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_vectors_of_long_texts_and_bad_bytes(spark, monkeypatch):
    text = "Ünder The sea-bed " * 1000
    whole = S.term_counts(text.encode())
    monkeypatch.setattr(S, "PIECE", 7)
    assert S.term_counts(text.encode()) == whole == {"Ünder".encode(): 1000, b"the": 1000, b"sea": 1000, b"bed": 1000}
    assert S.term_counts(b"one" * 9) == {b"one" * 9: 1}
    [row] = S.document_vectors(spark.createDataFrame([(1, "b a B", "l", "s")], "id int, text string, lang string, source string")).collect()
    assert dict(zip(map(bytes, row.terms), row.counts, strict=True)) == {b"a": 1, b"b": 2}
