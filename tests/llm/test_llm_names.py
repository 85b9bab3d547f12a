"""Operators that return whole rows keep every column, whatever it is called; two writers of one
ledger; texts on which a pattern could run long; damage of every kind in a replica."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivertrack.llm import jaccard_join, merkle_audit, quality_classifier, quality_rules, secret_scan
from rivertrack.llm.queries import op5_secret_scan
from rivertrack.sources.files import stage_path

MINE = (
    "_blob _spans blob spans row t hash _now now _id _said id said kept_id kept_said _host _path host path _rate _read "
    "_evidence evidence path_rate overall _row _text _w _l m_symbols f_symbols _lang _source n_words base_failed kept _c"
).split()
DOCS = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in MINE)


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i} and Other" for i in range(40))
    texts = [long, long + " token=abcdefgh12", "short", None, "", "password: 123456789 " + long.replace("word", "w")]
    rows = [(i, t, "en", "http://h/p", *["mine"] * len(MINE)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def _mine(rows):
    return all(r[c] == "mine" for r in rows for c in MINE)


def _run(name, docs):
    spark = docs.sparkSession
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, evidence int")
    return {
        "redact": lambda: secret_scan.redact(docs, stage_path(spark, "ledger")),
        "one_of_each": lambda: jaccard_join.one_of_each(docs, percent=80, words=5),
        "quality_keep": lambda: quality_classifier.quality_keep(docs, labels, lambda x: np.full(len(x), 0.9)),
        "quality_filter": lambda: quality_rules.quality_filter(docs),
    }[name]()


@pytest.mark.parametrize("name", ["redact", "one_of_each", "quality_keep", "quality_filter"])
def test_clashing_names(docs, name):
    out = _run(name, docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and _mine(got)
    if name == "redact":
        by = {r.doc_id: r.text for r in got}
        assert by[1].endswith(" [secret]") and by[5].startswith("[secret] ") and by[3] is None and by[4] == ""


@pytest.mark.parametrize("name", ["redact", "one_of_each", "quality_keep", "quality_filter"])
def test_no_rows(docs, name):
    out = _run(name, docs.limit(0))
    assert out.columns == docs.columns and out.count() == 0


def test_two_writers_of_a_ledger(spark, docs):
    ledger = stage_path(spark, "ledger")
    once = sorted(map(str, secret_scan.scan(docs, ledger).collect()))
    rows = secret_scan.read_ledger(spark, ledger).collect()
    spark.createDataFrame(rows, secret_scan.LEDGER).write.mode("append").parquet(ledger)  # the second one
    assert sorted(map(str, secret_scan.scan(docs, ledger).collect())) == once
    assert secret_scan.redact(docs, ledger).count() == docs.count()


def _spans(text):
    """The three base kinds as their contract words them."""
    kinds = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.I),
        "access": (r"AKIA[A-Z0-9]+", 0, 16, 0),
        "hex": (r"[0-9a-f]+", 0, 32, 0),
    }
    found = [
        (m.start(), n, kind, m.end())
        for n, (kind, (pattern, group, least, flags)) in enumerate(kinds.items())
        for m in re.finditer(pattern, text, flags | re.ASCII)
        if len(m.group(group)) >= least
    ]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)), [k for _, _, k, _ in found]


def test_op5_columns_against_the_patterns(spark, tmp_path):
    import hashlib

    pieces = ["api_key='", "APIKEY = ", "Token:", "é", "abcdefgh", "12345678", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 4, " ", "\n", '"', "="]
    import random

    rng = random.Random(9)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(20))) for _ in range(300)] + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op5_secret_scan(spark, str(tmp_path)).collect():
        said, kinds = _spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))


@pytest.mark.parametrize("unit", ["eyJ", "eyJ.", "AKIA", "password", "password ", "-----BEGIN ", "ghp_", "a", "f"])
def test_secret_patterns_are_linear(unit):
    find, text = secret_scan.finder(), unit * (400_000 // len(unit))
    began = time.perf_counter()
    find(text)
    assert time.perf_counter() - began < 10


def test_jwt_is_found():
    token = "eyJhbGciOi.eyJzdWIiOi.SflKxwRJSM"
    assert ("jwt", 4, 4 + len(token)) in secret_scan.finder()(f"use {token} now")


def test_records_without_an_id_are_spread(spark):
    pages = spark.range(5000).selectExpr("cast(null as bigint) as page_id", "concat('u', id) as url", "'b' as html")
    sizes = merkle_audit.records(pages).groupBy("archive").count()
    assert sizes.count() > 1000 and sizes.agg(F.max("count")).first()[0] < 20
    assert merkle_audit.records(pages).agg(F.max("archive")).first()[0] < 0


def test_audit_finds_every_kind_of_damage(spark):
    pages = spark.range(900).selectExpr("id as page_id", "concat('u', id) as url", "repeat('x', 300) as html")
    ours = merkle_audit.laid_out(merkle_audit.records(pages)).collect()
    table = spark.createDataFrame(ours)
    changed = {7: "bytes", 120: "length", 333: "lost", 899: "bytes"}
    theirs = [r for r in ours if changed.get(r.id) != "lost" and r.archive != 5]
    theirs = [
        {**r.asDict(), "digest": "0" * 64, "length": r.length + (changed[r.id] == "length")} if r.id in changed else r.asDict()
        for r in theirs
    ]
    got = {(r.id, r.status) for r in merkle_audit.audit(table, spark.createDataFrame(theirs, table.schema)).collect()}
    want = {(i, "missing" if how == "lost" else "changed") for i, how in changed.items()}
    assert got == want | {(i, "missing") for i in range(500, 600)}
    back = {(r.id, r.status) for r in merkle_audit.audit(spark.createDataFrame(theirs, table.schema), table).collect()}
    assert back == {(i, "extra" if s == "missing" else s) for i, s in got}
    assert merkle_audit.audit(table, table).count() == 0
