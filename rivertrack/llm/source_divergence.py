"""How far the sources of a language differ in the terms they use.

Every text becomes an exact sparse vector of term counts, as a count vectorizer makes it: a
language's vocabulary is every term in at least ``MIN_DOCS`` of its documents, and its size has
no limit. Vectors are summed by (language, source), and pairs of sources are compared on the
terms that either has; what all other terms add is one product. The vocabulary stays a table:
the class of Spark's ML library holds it on the driver and in every task, and grows there with the
corpus, so its steps are taken as DataFrame operations instead.

All numbers are integers. A term's share in a group of N counts over V kept terms is
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), so that a term the group lacks has the group's
least share. Nulls: a null text, language or source is an empty one. Rows that repeat count
each. A language without kept terms has V = 0: its sources differ by 0, and it has no terms. A
source alone in its language has no pairs. No rows, no results. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivertrack.llm.common import written

MIN_DOCS = 30
PRIOR = 5  # added to each kept term's count
UNIT = 1_000_000_000
MOST_TERMS = 50  # rows of the report's term part: the contract's ranks
PIECE = 1 << 20  # bytes of a text that are split into terms at once
TILE = 512  # sources whose sums one task compares with as many others
CELL_ROWS = 100_000  # (source, term) rows that one task compares, about

# every byte that is part of a term as it counts, all others as blanks: letters, lower-cased, and
# the bytes of characters beyond ASCII
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def term_counts(text):
    """Term -> count of a text given as UTF-8, counted piece by piece."""
    counts = {}
    clean, at = text.translate(_LETTERS), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        for term in clean[at:end].split():
            counts[term] = counts.get(term, 0) + 1
        at = end
    return counts


def document_vectors(docs, text="text"):
    """(lang, source, terms, counts) of every document: its sparse vector. One row per row."""

    def empty(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    rows = docs.select(
        empty("lang").alias("lang"), empty("source").alias("source"), empty(text).cast("binary").alias("text")
    )

    def run(batches):
        for batch in batches:
            found = [term_counts(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype("int32")
            terms = pa.array([t for c in found for t in c], pa.binary())
            counts = pa.array([n for c in found for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    batch.column("source"),
                    pa.ListArray.from_arrays(ends, terms),
                    pa.ListArray.from_arrays(ends, counts),
                ],
                names=["lang", "source", "terms", "counts"],
            )

    return rows.mapInArrow(
        run, "lang string, source string, terms array<binary>, counts array<bigint>"
    )


def group_sums(vectors):
    """Summed vectors: (lang, source, term, count, docs), combined in every task first."""
    entry = F.explode(F.arrays_zip("terms", "counts")).alias("e")
    return (
        vectors.select("lang", "source", entry)
        .groupBy("lang", "source", F.col("e.terms").alias("term"))
        .agg(F.sum("e.counts").alias("count"), F.count(F.lit(1)).alias("docs"))
    )


def vocabulary_sums(sums, min_docs=MIN_DOCS):
    """The sums of kept terms, with the count of the term in the whole language."""
    term = Window.partitionBy("lang", "term")
    return (
        sums.withColumns({"all_docs": F.sum("docs").over(term), "lang_count": F.sum("count").over(term)})
        .where(F.col("all_docs") >= min_docs)
        .select("lang", "source", F.col("term").cast("string").alias("term"), "count", "lang_count")
    )


def _share(count, total, kept):
    """Exact for any sums: the product is a decimal."""
    unit = F.lit(UNIT).cast("decimal(10,0)")
    whole = F.col(total).cast("decimal(20,0)") + PRIOR * F.col(kept).cast("decimal(19,0)")
    share = F.call_function("div", unit * (count.cast("decimal(20,0)") + PRIOR), whole)
    return F.when(F.col(kept) > 0, 1 + share).cast("bigint")


def groups(docs, sums):
    """Every occurring (lang, source) with N, the language's N and V, the number of the source in
    its language, and ``least``, the share of a term it lacks (null where V is 0)."""
    found = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    ).distinct()
    own = sums.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    terms = sums.groupBy("lang", "term").agg(F.max("lang_count").alias("n"))
    whole = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("n").alias("kept"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("total", "lang_total", "kept")}
    return (
        found.join(own, ["lang", "source"], "left")
        .join(whole, "lang", "left")
        .withColumns(zero)
        .withColumns({"number": number, "least": _share(F.lit(0), "total", "kept")})
    )


def _differences(sources, entries, others, other_entries):
    """For each source a: (a's number, for each of ``others`` how much the terms of the cell that
    either has add to their difference, over what the least shares of both say for a term)."""
    other_number, other_least = others["number"].to_numpy(), others["least"].to_numpy()
    of = np.searchsorted(other_number, other_entries["number"].to_numpy())
    order = np.argsort(of, kind="stable")
    of = of[order]
    term, share = (other_entries[c].to_numpy()[order] for c in ("term_id", "share"))
    seen, starts = np.unique(of, return_index=True)
    width = int(term.max()) + 1 if len(term) else 0
    mine_of = dict(tuple(entries.groupby("number")[["term_id", "share"]]))
    for number, least in zip(sources["number"], sources["least"], strict=True):
        base = np.abs(least - other_least)
        total = np.zeros(len(others), dtype="int64")
        said, has = np.full(width, least), np.zeros(width, dtype=bool)
        if number in mine_of:
            terms, shares = (mine_of[number][c].to_numpy() for c in ("term_id", "share"))
            total += np.abs(shares[:, None] - other_least).sum(axis=0) - len(terms) * base
            within = terms < width
            said[terms[within]], has[terms[within]] = shares[within], True
        if len(term):
            there = said[term]
            counted = np.where(has[term], np.abs(there - other_least[of]), base[of])
            total[seen] += np.add.reduceat(np.abs(share - there) - counted, starts)
        yield number, base, total


def pair_values(known, sums):
    """(lang, a, b, value) for the numbers a < b of any two sources of a language.

    Sources are cut into tiles and terms into cells; a task compares two tiles on one cell, and
    only its sums leave it: no pair of rows is ever made for a term, and no language, source or
    term is held whole. A cell has a row for each of its language's sources as well, so that one
    without a term there is compared like the others."""
    per = known.groupBy("lang").agg(F.max("number").alias("last"))
    rows = sums.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    cells = F.greatest(F.ceil(F.coalesce("rows", F.lit(0)) / CELL_ROWS), F.lit(1))
    sources = known.join(
        per.join(rows, "lang", "left").withColumn("cells", cells).drop("rows"), "lang"
    )
    numbers = ["lang", "number", "least", "kept", "last", "cells"]
    share = _share(F.col("count"), "total", "kept")
    entries = (
        sums.join(sources, ["lang", "source"])
        .select(*numbers, "term", share.alias("share"))
        .withColumn("cell", F.pmod(F.xxhash64("term"), F.col("cells")))
    )
    everywhere = sources.select(
        *numbers,
        F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("bigint").alias("share"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)).alias("cell"),
    )
    tile = F.floor(F.col("number") / TILE)
    tiles = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / TILE))
    placed = (
        entries.unionByName(everywhere)
        .withColumns({"tile": tile, "other": F.explode(tiles)})
        .select(
            "lang", "cell", "number", "least", "kept", "term", "share",
            F.least("tile", "other").alias("low"),
            F.greatest("tile", "other").alias("high"),
        )
    )

    def compare(rows):
        import pandas as pd

        lang, cell, low, high = (rows[c].iloc[0] for c in ("lang", "cell", "low", "high"))
        rows = rows.assign(least=rows["least"].fillna(0).astype("int64"), term_id=pd.factorize(rows["term"])[0])

        def side(tile):
            part = rows[rows["number"] // TILE == tile]
            entries = part[part["term_id"] >= 0].astype({"share": "int64"})
            return part[part["term_id"] < 0].sort_values("number"), entries

        first, second = side(low), side(high)
        kept = int(rows["kept"].iloc[0]) if cell == 0 else 0
        others = second[0]["number"].to_numpy()
        out = []
        for number, base, total in _differences(*first, *second):
            ahead = others > number
            values = (total + kept * base)[ahead]
            out.append(pd.DataFrame({"lang": lang, "a": number, "b": others[ahead], "value": values}))
        return pd.concat(out)

    parts = placed.groupBy("lang", "cell", "low", "high").applyInPandas(
        compare, "lang string, a bigint, b bigint, value bigint"
    )
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows, part, most=None):
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def divergence(docs, text="text", min_docs=MIN_DOCS, most_terms=MOST_TERMS):
    """Per (lang, source): all other sources of the language by how far their shares differ
    (part ``pair``), and the terms it uses most above its language (part ``term``)."""
    sums = group_sums(document_vectors(docs, text))
    sums = written(vocabulary_sums(sums, min_docs), "term-sums")
    known = written(groups(docs, sums), "source-groups")
    values = pair_values(known, sums)
    both = values.unionByName(values.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = known.select("lang", "number", "source")
    pairs = both.join(name.withColumnRenamed("number", "a"), ["lang", "a"]).join(
        name.withColumnsRenamed({"number": "b", "source": "item"}), ["lang", "b"]
    )
    shares = sums.join(known, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        (_share(F.col("count"), "total", "kept") - _share(F.col("lang_count"), "lang_total", "kept")).alias("value"),
    )
    terms = shares.where(F.col("value") > 0)
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term", most_terms))


def oracle_sql():
    """The same in DuckDB's SQL, every term of every pair spelled out."""
    share = f"1 + ({UNIT}::HUGEINT * ({{}} + {PRIOR})) // ({{}} + {PRIOR} * V)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
), own AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), langs AS (
  SELECT lang, count(k.term) AS V, coalesce(sum(k.n), 0) AS total
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept k USING (lang) GROUP BY lang
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(own.n), 0) AS total
  FROM g LEFT JOIN own USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT totals.lang, totals.source, kept.term, coalesce(own.n, 0) AS n,
         {share.format("coalesce(own.n, 0)", "totals.total")} AS p,
         {share.format("kept.n", "langs.total")} AS q
  FROM totals JOIN langs USING (lang) JOIN kept USING (lang)
  LEFT JOIN own ON own.lang = totals.lang AND own.source = totals.source AND own.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS f
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  JOIN shares x ON x.lang = a.lang AND x.source = a.source
  JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.f, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER
    AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
