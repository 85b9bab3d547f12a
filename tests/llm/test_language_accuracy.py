"""Held-out accuracy, the bound on the sample, and cuts between characters."""

import re

import pyarrow.parquet as pq
import pytest

from rivertrack.llm import language_id
from rivertrack.llm.queries import op4_language_id

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    lang = {d["doc_id"]: d["lang"] for d in docs}
    scored = {d["doc_id"] for d in docs if d["lang"] and re.search(r"[^\W\d_]", d["text"] or "")}
    got = [r for r in op4_language_id(spark, SF_DIR).collect() if r.held_out and r.doc_id in scored]
    assert len(got) > 200
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and 0 <= r.n_agree <= r.n_positions for r in got)


@pytest.mark.parametrize("most, want", [(60_000, 4), (5, 2)])
def test_sample_is_bounded(spark, monkeypatch, most, want):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 4)
    monkeypatch.setattr(language_id, "MOST_SAMPLED", most)
    seen = []
    monkeypatch.setattr(language_id.Network, "fit", lambda self, words, labels: seen.append((words, labels)) or self)
    rows = [(i, f"t{i}", "a" if i % 100 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    network = language_id.train(docs, language_id.remainder("doc_id") >= 0)
    [(words, labels)] = seen
    assert network.languages == ["a", "b"]
    assert 0 < labels.tolist().count(0) <= want and 0 < labels.tolist().count(1) <= want
    assert language_id.train(docs.limit(0), language_id.remainder("doc_id") >= 0) is None


def test_cuts_lie_between_characters():
    for text in ("日本語の文章は空白で分かれない" * 9, "é" * 100, "x" * 100, "😀" * 30 + "a", "ab" * 40 + "語"):
        parts = language_id.pieces(text)
        assert "".join(p.decode() for p in parts) == text
        assert all(0 < len(p) <= language_id.LONGEST for p in parts)
        assert all(len(p) > language_id.LONGEST - 4 for p in parts[:-1])
