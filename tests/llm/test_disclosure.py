"""Personal data and disclosing terms against brute force, edge cases and hostile texts."""

import itertools
import random
import re
import time

import pytest

from rivertrack.llm import disclosure

DOCS = "doc_id bigint, text string, lang string, hash string, row string, t string, terms string, _masked string"
PATTERNS = {  # as the contract words them
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, said):
    digits = re.sub("[^0-9]", "", said)
    if kind == "ip":
        return all(int(p) <= 255 for p in said.split("."))
    if kind == "card":
        luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [
        (m.start(), n, kind, m.end())
        for n, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text)
        if _valid(kind, m.group())
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_base_matches_are_those_of_the_patterns():
    rng = random.Random(7)
    pieces = ["@", ".", "a", "b-c", "1", "25", "255", "256", "007", "4111 1111 1111 1111", "+", " ", "-", "(", ")",
              "x@y.z", "10.0.0.1", "+44 20 7946 0958", "é", "\n", "__", "%", "5500005555555559"]
    for _ in range(30_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert [s[:3] for s in disclosure.entities(text)] == brute(text), repr(text)


@pytest.mark.parametrize(
    "unit", ["a", "1", "1.", "1 ", "+1", "+1 -", "@", "a@", "a@b", "a.", "-", "1-", "x@a.b@", "4 1 1 1-"]
)
def test_time_grows_with_the_length(unit):
    text = unit * (300_000 // len(unit))
    began = time.perf_counter()
    disclosure.find(text, ["a"])
    disclosure.contexts(text)
    assert time.perf_counter() - began < 20


def _corpus():
    """Three entities: Zorbel stands near the first wherever it does, ``common`` nearly anywhere."""
    rng = random.Random(11)
    fill = [f"word{i}" for i in range(400)]

    def words(n):
        return " ".join(rng.choice(fill) for _ in range(n))

    texts = [f"{words(30)} common Zorbel mail anna@lake.org today {words(30)}" for _ in range(6)]
    texts += [f"{words(20)} common call +1 202 555 01{i:02} soon {words(20)}" for i in range(5)]
    texts += [f"Zorbel {words(25)} anna@lake.org {words(3)} zorbel anna@lake.org {words(12)} Zorbel"]
    texts += [f"{words(30)} common {words(5)} Quist {words(9)}" for _ in range(40)]
    texts += [f"{words(9)} Quist 10.1.2.3 {words(9)}" for _ in range(5)]  # Quist stands elsewhere too
    texts += [f"{words(9)} Rare bob@sea.org {words(9)}"] * 30  # one text, however many copies
    return [*texts, None, "", " ", "@", "no personal data Zorbel"]


@pytest.fixture(scope="module")
def texts():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 3 else i, t, "en", *"hrtmk") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def wanted(texts):
    """(entity, term) -> (texts with the term near the entity, texts with the term), all pairs."""
    different = sorted({t or "" for t in texts})
    terms = {t: {x for w in re.findall(r"[^\W_]+", t) for x in (w.lower(), disclosure.shape(w))} for t in different}
    near = {}
    for t in different:
        spans = brute(t)
        free = [
            m for m in re.finditer(r"[^\W_]+", t)
            if not any(a < m.end() and m.start() < b for _, a, b in spans)
        ]
        for kind, a, b in spans:
            entity = t[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])
            close = [m for m in free if m.end() <= a][-disclosure.WINDOW :]
            close += [m for m in free if m.start() >= b][: disclosure.WINDOW]
            for m in close:
                for term in (m.group().lower(), disclosure.shape(m.group())):
                    near.setdefault((f"{kind}:{entity}", term), set()).add(t)
    out = {}
    for (entity, term), both in near.items():
        n = sum(term in terms[t] for t in different)
        if len(both) >= disclosure.MIN_TEXTS and n <= 2 * len(both):
            out[entity, term] = (len(both), n)
    return out, near


def test_disclosures_are_those_of_all_pairs(docs, texts):
    near = disclosure.mentions(docs)
    got = {(r.entity, r.term): (r.n_both, r.n_term) for r in disclosure.disclosures(docs, near).collect()}
    want, _ = wanted(texts)
    assert got == want
    assert ("email:anna@lake.org", "zorbel") in want
    assert not any(term in ("common", "quist", "rare") for _, term in want)


def test_disclosures_by_a_join_and_after_a_first_count(docs, texts, monkeypatch):
    want, _ = wanted(texts)
    for name, value in (("MOST_BROADCAST", 0), ("FIRST_LOOK", ""), ("FIRST_LOOK", "0")):
        with monkeypatch.context() as m:
            m.setattr(disclosure, name, value)
            near = disclosure.mentions(docs)
            got = {(r.entity, r.term): (r.n_both, r.n_term) for r in disclosure.disclosures(docs, near).collect()}
            assert got == want


@pytest.mark.parametrize("most", [disclosure.MOST_BROADCAST, 0])
def test_spans(docs, texts, monkeypatch, most):
    monkeypatch.setattr(disclosure, "MOST_BROADCAST", most)
    want, near = wanted(texts)
    rows = []
    for i, t in enumerate(texts):
        t = t or ""
        hidden = {term for entity, term in want if t in near[entity, term]}
        spans = brute(t)
        for m in re.finditer(r"[^\W_]+", t):
            if m.group().lower() in hidden and not any(a < m.end() and m.start() < b for _, a, b in spans):
                kind = "remove" if disclosure.shape(m.group()) in hidden else "generalise"
                spans.append((kind, m.start(), m.end()))
        spans.sort(key=lambda s: s[1])
        rows.append((None if i == 3 else i, spans))
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in disclosure.scan(docs).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert rows[-1][1] == [] and any(s[0] == "generalise" for _, s in rows for s in s)


def test_sanitised_texts_keep_rows_and_clashing_columns(spark, docs, texts):
    out = disclosure.sanitise(docs).collect()
    assert len(out) == len(texts) and out[0].asDict().keys() == set(docs.columns)
    assert all((r.hash, r.row, r.t, r.terms, r._masked) == tuple("hrtmk") for r in out)
    by = {r.doc_id: r.text for r in out}
    assert "anna" not in by[0] and "Zorbel" not in by[0] and "[email]" in by[0] and "<Aa>" in by[0]
    assert by[11].count("<Aa>") == 2 and by[11].count("<a>") == 1
    assert by[len(texts) - 1] == texts[-1] and by[len(texts) - 5] is None
    empty = spark.createDataFrame([], DOCS)
    assert disclosure.sanitise(empty).count() == disclosure.scan(empty).count() == 0


def test_masking_where_kinds_overlap(spark):
    text = "see 10.0.0.1@host.example.com or +4111 1111 1111 1111 end"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    spans = disclosure.find(text, None)
    assert [(k, a, b) for k, a, b in spans] == brute(text)
    assert any(a < d and c < b for (_, a, b), (_, c, d) in itertools.combinations(spans, 2))
    masked = disclosure.sanitise(docs).first().text
    assert masked == "see [email] or +[card] end"
