"""The stages of the pipeline against plain Python."""

import itertools
import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rivertrack.llm import quality_classifier, quality_rules
from rivertrack.llm.common import written

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def near_kept(texts, words=5, percent=80):
    """The ids of ``texts`` {id: text} that are the smallest of their component, by all pairs."""
    sets = {}
    for key, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        whole = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
        sets[key] = whole or ({tuple(w)} if w else set())
    label = {key: key for key in sets}
    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {k: new if x == old else x for k, x in label.items()}
    return {key for key, x in label.items() if key == x}


def near_texts():
    """Groups of near copies with 0 to 6 words exchanged in a row or apart, and short texts."""
    rng = random.Random(23)
    texts = [None, "", "one", "One", "a b c d", "a b c d e", "A b c d e", "a b c d e f", "a b c d e f g h i", "a b c d e f g h i j"]
    for g in range(6):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(90)]
        for _ in range(12):
            copy, k = list(base), rng.randrange(7)
            apart = rng.sample(range(90), k)
            together = range(start := rng.randrange(80), start + k)
            for i in rng.choice((apart, together)):
                copy[i] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return dict(enumerate(texts))


def test_near_duplicate_stage_equals_all_pairs(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOCS)
    kept = corpus_pipeline.jaccard_join_stage(spark, docs, None)
    want = near_kept(texts)
    assert want != near_kept(texts, 3, 90)  # the setting of op8's query
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def rules_kept(rows):
    """The rows that the base rules and the fences of all documents keep (all groups are small)."""
    measured = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        lines = [x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        repeats = len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)})
        n, chars, capitals = len(w), sum(map(len, w)), sum(x.isupper() for x in r[1] or "")
        symbols = len(re.findall(r"[#*$%&|<>]", r[1] or ""))
        parts = {"symbols": (symbols, n), "repeats": (repeats, n), "dup_lines": (len(lines) - len(set(lines)), len(lines))}
        parts |= {"capitals": (capitals, chars), "word_length": (chars, n)}
        measures = {k: a * 1000 // b if b else 0 for k, (a, b) in parts.items()}
        measured.append((r, measures, n < 50 or 100 * repeats > 50 * n))
    fence = {}
    for m, least in quality_rules.MEASURES.items():
        low = [max(x[m].bit_length() - 6, 0) for _, x, _ in measured]
        v = sorted(x[m] >> k << k for (_, x, _), k in zip(measured, low, strict=True))
        q1, q3 = (v[math.ceil(len(v) * q / 100) - 1] for q in (25, 75))
        fence[m] = q3 + 3 * max(q3 - q1, least)
    return [r for r, x, failed in measured if not failed and all(x[m] <= fence[m] for m in fence)]


def sites_kept(rows, known, model):
    """The rows whose text and site speak for them."""
    paths, hosts, total, seen = {}, {}, [0, 0.0], []
    for r in rows:
        e = float(model(quality_classifier.features(r[1])[None])[0])
        host = r[3] or ""
        path = (host, f"{host}/{r[2] or ''}")
        seen.append((r, e, path))
        for cell in (paths.setdefault(path, [0, 0.0]), hosts.setdefault(host, [0, 0.0]), total):
            cell[0] += 1
            cell[1] += known.get(r[0], e)
    overall = min(0.999, max(0.001, total[1] / total[0]))
    rate = {None: overall}
    for groups, up in ((hosts, lambda k: None), (paths, lambda k: k[0])):
        q = {k: rate[up(k)] for k in groups}
        spread = sum(n * (s / n - q[k]) ** 2 for k, (n, s) in groups.items())
        noise = sum(q[k] * (1 - q[k]) for k in groups)
        room = sum(q[k] * (1 - q[k]) * (n - 1) for k, (n, _) in groups.items())
        m = min(1e4, max(1.0, room / (spread - noise) - 1)) if spread > noise and room else 1e4
        rate |= {k: (s + m * q[k]) / (n + m) for k, (n, s) in groups.items()}

    def log_odds(p):
        p = min(1 - 1e-6, max(1e-6, p))
        return math.log(p / (1 - p))

    return [r for r, e, path in seen if log_odds(e) + log_odds(rate[path]) - log_odds(overall) >= 0]


def test_all_stages_equal_plain_python(spark, tmp_path):
    texts = near_texts()
    rows = [(k, t, [None, "en", "fr"][k % 3], [None, "s", "u"][k % 5 % 3], len(t or "")) for k, t in texts.items()]
    rng = random.Random(4)
    for k in range(200, 212):
        words = [f"p{rng.randrange(10**6)}" for _ in range(70)]
        secret = ["AKIA" + "Q7" * 10] if k % 2 else []
        rows.append((k if k > 200 else None, " ".join(words + secret + ["end"]), "en", "s", 9))
    rows += [(300, "same words " * 60, "en", "s", 0), (301, " ".join(f"$$$$### {i}" for i in range(60)), "en", "s", 0)]
    rows += [rows[20], rows[-3], (400, rows[20][1], "fr", None, 1), (401, None, None, None, None)]
    known = {k: float(k % 4 != 0) for k in range(10, 60)}
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(v), 0) for k, v in known.items()], "doc_id bigint, quality int, toxic int")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_classifier.fit(docs, labels)

    ruled = rules_kept(rows)
    sited = sites_kept(ruled, known, model)
    smallest = near_kept({r[0]: r[1] for r in sited})
    alone = list({r[0]: r for r in sited if r[0] in smallest}.values())
    clean = [(*r[:4], len(t), t) for r in alone for t in [re.sub("AKIA[A-Z0-9]{12,}", "[secret]", r[1])]]
    clean = [(r[0], r[5], *r[2:5]) for r in clean]
    assert len(rows) > len(ruled) > len(alone) > 0 and any("[secret]" in r[1] for r in clean)
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], (ruled, sited, alone, clean), strict=True):
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted(want, key=repr)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    said = {}
    for p in sorted(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), key=lambda p: p.start):
        said.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert said == {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1] for r in clean}


def test_all_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
