"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivertrack.llm import jaccard_join, language_id, piecewise_hash, quality_classifier

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.mark.parametrize("quality", [None, 0, 1])
def test_classify_and_keep_agree(spark, quality):
    """With labels that differ by site and undecided texts, and with a fit on labels of one class."""
    rows = [(i, f"Text {i} about rivers.", "en", "http://a/x" if i < 30 else "http://b/y", 0) for i in range(60)]
    rows += [(None, None, None, None, 0), (None, "A text without an id.", "en", "http://b/y", 0), rows[41]]
    docs = spark.createDataFrame(rows, DOCS)
    known = [(i, int(i < 30) if quality is None else quality, 0) for i in range(57)]
    labels = spark.createDataFrame(known, LABELS)
    model = quality_classifier.fit(docs, labels) if quality is not None else lambda x: np.full(len(x), 0.55)
    judged = quality_classifier.classify(docs, labels, model).collect()
    kept = [r.doc_id for r in quality_classifier.quality_keep(docs, labels, model).collect()]
    want = [r.doc_id for r in judged if r.kept]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
    if quality is None:  # the unlabelled 58 goes by the labels of its site
        assert set(kept) == {*range(30), None}


def test_jaccard_null_id_is_not_the_smallest(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    docs = spark.createDataFrame([(None, text, "en", "s", 0), (7, near, "en", "s", 0), (5, text, "en", "s", 0)], DOCS)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {None: 5, 5: 5, 7: 5}
    assert [r.doc_id for r in jaccard_join.one_of_each(docs).collect()] == [5]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_signature_holds_every_chunk():
    unit = next(u for i in range(9999) if len(piecewise_hash._ends((u := f"row {i:04} x ".encode()) * 300)[1]) > 250)
    text = unit * 300
    half = b"".join(b"%d-" % (i * i) for i in range(9999))[: len(text) // 2]
    other = text[: len(text) - len(half)] + half
    marks = [piecewise_hash.fingerprint(t) for t in (text, other)]
    ends = piecewise_hash._ends(text)[1]
    assert len(marks[0].split(":")[1]) == len(ends) + (ends[-1] < len(text))
    parts = [m.split(":")[1:] for m in marks]
    far = [_distance(a, b) / max(len(a), len(b)) for a, b in zip(*parts, strict=True)]
    assert piecewise_hash.likeness(*marks) in (1 - min(far), 1 - far[0])
    assert piecewise_hash.likeness(*marks) < 0.9


def test_every_language_is_learned(spark):
    rows = [(i, f"tongue{i % 230} speaks", f"l{i % 230:03}", "s", 0) for i in range(460)]
    docs = spark.createDataFrame(rows, DOCS)
    network = language_id.train(docs, F.lit(True))
    assert network.languages == [f"l{i:03}" for i in range(230)]
    assert language_id.predict(docs, network).count() == 460
