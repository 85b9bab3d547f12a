"""Document quality by hierarchical empirical Bayes.

A logistic classifier reads each text. Its probabilities (known labels, where there are any) are
summed by site path and by host. A host's rate is shrunk towards the rate of all documents and a
path's rate towards its host's, the more the fewer documents it has: the strength of each prior
is estimated from how much the rates differ beyond chance (method of moments). A document's
score adds the log odds of its text and what its path's rate tells beyond the overall rate.

Groups are only ever sums, combined before the shuffle. The driver sees a bounded sample of
labelled feature rows (MOST_TRAINED) and a few numbers per level.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rivertrack.llm.common import map_batches, short_batches, written

MOST_TRAINED = 4000  # labelled documents that the classifier is fitted on, by hash of their id
KEEP_FROM = 0.5
RIDGE, STEPS = 1.0, 25
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0


def features(text):
    """Shares of the 256 byte values (square roots), and of distinct, long and upper-case words."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n = len(words)
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum())
    return np.concatenate([
        np.sqrt(counts / max(1, len(data))),
        [
            len(set(words)) / n if n else 0.0,
            np.log1p(n) / 10,
            min(4.0, len(data) / max(1, n) / 10),
            upper / max(1, letters),
            (len(data) - letters) / max(1, len(data)),
        ],
    ])


class Classifier:
    """Logistic regression on standardised features, fitted by Newton steps with a ridge."""

    def __init__(self, x, y):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), RIDGE)
        ridge[-1] = 1e-6
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((x.T * curve) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def __call__(self, x):
        z = ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit(docs, labels, id_col="doc_id", text="text", label="quality"):
    """A classifier from at most MOST_TRAINED labelled documents, or the constant rate of the
    labels if they are all alike (0.5 without any)."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.avg(label).alias("_y"))
    # ordered by hash: a fixed sample, each task passing on at most its first MOST_TRAINED
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(MOST_TRAINED)
    rows = docs.join(F.broadcast(sample), id_col).select("_y", text).limit(2 * MOST_TRAINED)

    def start():
        def step(y, texts):
            return y, [features(t) for t in texts]

        return step

    rows = map_batches(rows, "y double, x array<double>", start).toPandas()
    y = (rows["y"].to_numpy() >= 0.5).astype(float)
    if len(y) == 0 or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        return lambda x: np.full(len(x), rate)
    x = np.array(rows["x"].tolist())
    order = np.lexsort((y, x.sum(axis=1)))  # rows arrive in any order; sums should not
    return Classifier(x[order], y[order])


def evidence(docs, model, keep, text="text"):
    """Rows (*keep, evidence): the classifier's probability for each text, whole texts, narrow."""

    def start():
        def step(*columns):
            return [*columns[:-1], model(np.stack([features(t) for t in columns[-1]]))]

        return step

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return map_batches(docs.select(*keep, text), ", ".join([*fields, "evidence double"]), start)


def site(source="source", lang="lang"):
    """(host, path): the parts of a URL up to its first folder, or else the source and its section
    of one language. Null is a host, and a section, of its own."""
    url = F.col(source).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    host = F.when(url, F.regexp_extract(source, r"^[^:]+://([^/?#]*)", 1)).otherwise(F.col(source))
    folder = F.when(url, F.regexp_extract(source, r"^[^:]+://[^/?#]*(/[^/?#]*)?", 1)).otherwise(
        F.concat(F.lit("/"), F.coalesce(F.col(lang), F.lit("")))
    )
    host = F.coalesce(host, F.lit(""))
    return host, F.concat(host, folder)


def _strength(groups, prior):
    """Prior strength, in documents, from the spread of group rates about ``prior`` that sampling
    does not explain: with binomial noise, E[n (rate - prior)^2] = q (1 + (n - 1) / (M + 1))."""
    q = prior * (1 - prior)
    row = groups.filter("n > 0").agg(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - prior) ** 2).alias("spread"),
        F.sum(q).alias("noise"),
        F.sum(q * (F.col("n") - 1)).alias("room"),
    ).first()
    excess = (row.spread or 0.0) - (row.noise or 0.0)
    if excess <= 0 or not row.room:
        return MOST_STRENGTH
    return float(np.clip(row.room / excess - 1, LEAST_STRENGTH, MOST_STRENGTH))


def posteriors(rows):
    """From rows (host, path, p): per path (host, path, n, host_rate, path_rate), and the overall
    rate. Hosts are sums of their paths; a hot host is as many rows as it has paths."""
    paths = written(rows.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = min(0.999, max(0.001, total.s / total.n)) if total.n else 0.5
    m = _strength(hosts, F.lit(overall))
    host_rate = (F.col("s") + m * overall) / (F.col("n") + m)
    hosts = written(hosts.select("host", host_rate.alias("host_rate")), "site-hosts")
    both = paths.join(hosts, "host")
    k = _strength(both, F.col("host_rate"))
    path_rate = (F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)
    return written(both.select("host", "path", "n", "host_rate", path_rate.alias("path_rate")), "site-rates"), overall


def _site_rates(rows, labels, id_col, label):
    """`posteriors` of rows (id, host, path, evidence), known labels in place of the evidence."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(id_col).agg(F.avg(label).alias("_y"))
    informed = rows.join(known, id_col, "left").select("host", "path", F.coalesce("_y", "evidence").alias("p"))
    return posteriors(informed)


def _score(evidence, path_rate, overall):
    """A document's score; no evidence is worth more than a millionth from certainty."""

    def log_odds(p):
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))

    odds = log_odds(F.col(evidence)) + log_odds(F.col(path_rate)) - log_odds(F.lit(overall))
    return 1 / (1 + F.exp(-odds))


def classify(docs, labels, model=None, id_col="doc_id", text="text", source="source", lang="lang", label="quality"):
    """One row (id, host, path, evidence, host_rate, path_rate, score, kept) per row of ``docs``.

    A null text has no bytes and is judged as such; a null source or language is a site of its
    own; a null id has no label. Repeated rows are judged each; an empty table gives none. Other
    columns of ``docs`` are not read."""
    if model is None:
        model = fit(docs, labels, id_col, text, label)
    host, path = site(source, lang)
    placed = docs.withColumns({"_host": host, "_path": path})
    rows = evidence(placed, model, (id_col, "_host", "_path"), text)
    rows = written(rows.withColumnsRenamed({"_host": "host", "_path": "path"}), "quality-evidence")
    rates, overall = _site_rates(rows, labels, id_col, label)
    score = _score("evidence", "path_rate", overall)
    return rows.join(rates.drop("n"), ["host", "path"]).select(
        id_col, "host", "path", "evidence", "host_rate", "path_rate",
        score.alias("score"), (score >= KEEP_FROM).alias("kept"),
    )


def quality_keep(docs, labels, model, text="text", source="source", lang="lang", id_col="doc_id", label="quality"):
    """The rows of ``docs`` that `classify` keeps, with all their columns and only those. A
    first pass sums the sites, a second judges each row where it is read; texts do not move
    unless the sites are too many for Spark to broadcast their rates. A row travels as one
    struct, so that no name can clash. A null text is judged as an empty one, a null source or
    language is a site of its own, a null id has no label, and repeated rows are judged each."""
    short_batches(docs.sparkSession)
    host, path = site(source, lang)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    placed = docs.select(
        whole.alias("row"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"),
        _evidence(model)(text).alias("evidence"),
    )
    sums = placed.select("id", "host", "path", "evidence")
    rates, overall = _site_rates(sums, labels.withColumnRenamed(id_col, "id"), "id", label)
    rates = rates.select("host", "path", "path_rate")
    kept = placed.join(rates, ["host", "path"]).filter(_score("evidence", "path_rate", overall) >= KEEP_FROM)
    return kept.select("row.*")


def _evidence(model):
    """The classifier as a function of the text column: only texts leave the JVM."""

    def evidence(texts: pa.Array) -> pa.Array:
        found = [features(t) for t in texts.to_pylist()]
        return pa.array(model(np.stack(found)) if found else [], pa.float64())

    return F.arrow_udf(evidence, "double")
