"""One query per operator of this subpackage, over whole tables, and SQL where it can say it."""

import public_tokenizers
from pyspark.sql import functions as F

from rivertrack.llm import (
    byte_bpe,
    centroids,
    disclosure,
    jaccard_join,
    language_id,
    license_scan,
    merkle_audit,
    packing,
    piecewise_hash,
    quality_classifier,
    quality_rules,
    secret_scan,
    source_divergence,
)
from rivertrack.llm.common import table, written
from rivertrack.sources.files import stage_path

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", *quality_rules.COUNTS[1:], "base_failed", "kept"
    )


_OP9_INSIDE = " AND ".join(f"m_{m} <= f_{m}" for m in quality_rules.MEASURES)
_OP9_FENCES = ", ".join(
    f"max(CASE WHEN measure = '{m}' THEN q3 + {quality_rules.SPREADS} * greatest(q3 - q1, least) END) AS f_{m}"
    for m in quality_rules.MEASURES
)
_OP9_CHOSEN = ", ".join(
    f"CASE WHEN a.n >= {quality_rules.MIN_GROUP} THEN a.f_{m} WHEN b.n >= {quality_rules.MIN_GROUP} "
    f"THEN b.f_{m} ELSE c.f_{m} END AS f_{m}"
    for m in quality_rules.MEASURES
)

ORACLE["op9_quality_rules"] = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM texts
), windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM split)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows)
  WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice)
  GROUP BY r
), counted AS (
  SELECT s.doc_id, s.lang, s.source, len(w) AS n_words,
         len(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
         len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals
  FROM split s LEFT JOIN covered c USING (r)
), measured AS (
  SELECT *,
    CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS m_symbols,
    CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS m_repeats,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS m_dup_lines,
    CASE WHEN word_chars > 0 THEN n_capitals * 1000 // word_chars ELSE 0 END AS m_capitals,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS m_word_length
  FROM counted
), cells AS (
  SELECT lang, source, p.m AS measure, p.least AS least, p.v AS v,
         greatest(length(bin(p.v)) - 6, 0)::INTEGER AS low
  FROM (SELECT lang, source, unnest([{", ".join(
      f"{{m: '{m}', v: m_{m}::BIGINT, least: {least}}}" for m, least in quality_rules.MEASURES.items()
  )}]) AS p FROM measured)
), buckets AS (
  SELECT lang, source, measure, least, (v >> low) << low AS b FROM cells
), sketch AS (
  SELECT 0 AS level, lang, source, measure, least, b, count(*) AS n FROM buckets GROUP BY ALL
  UNION ALL
  SELECT 1, lang, NULL, measure, least, b, count(*) FROM buckets GROUP BY ALL
  UNION ALL
  SELECT 2, NULL, NULL, measure, least, b, count(*) FROM buckets GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM sketch
), quartiles AS (
  SELECT level, lang, source, measure, least, max(total) AS n,
         min(CASE WHEN 100 * upto >= 25 * total THEN b END) AS q1,
         min(CASE WHEN 100 * upto >= 75 * total THEN b END) AS q3
  FROM ranked GROUP BY ALL
), fences AS (
  SELECT level, lang, source, max(n) AS n, {_OP9_FENCES} FROM quartiles GROUP BY ALL
), cutoffs AS (
  SELECT a.lang, a.source, {_OP9_CHOSEN}
  FROM fences a JOIN fences b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM a.lang
  JOIN fences c ON c.level = 2 WHERE a.level = 0
), judged AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {_OP9_INSIDE} AS inside
  FROM measured m JOIN cutoffs c
    ON c.lang IS NOT DISTINCT FROM m.lang AND c.source IS NOT DISTINCT FROM m.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND inside AS kept
FROM judged
"""


@query
def op5_secret_scan(spark, sf_dir):
    ledger = stage_path(spark, "secret-ledger")
    rows = secret_scan.scan(table(spark, sf_dir, "documents"), ledger)

    def said(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secret_scan.BASE],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


@query
def op10_packing(spark, sf_dir):
    pieces = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@query
def op2_byte_bpe(spark, sf_dir):
    vocabulary = byte_bpe.Vocabulary.from_file(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    rows = byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op3_piecewise_hash(spark, sf_dir):
    return piecewise_hash.edit_chain(table(spark, sf_dir, "documents"))


@query
def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("said")


@query
def op4_language_id(spark, sf_dir):
    rows = language_id.held_out_languages(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "held_out", "lang_pred", "score", "n_positions", "n_agree")


@query
def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query
def op7_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


ORACLE["op7_license_scan"] = license_scan.oracle_sql()


@query
def op6_merkle_audit(spark, sf_dir):
    """All pages as archive files, audited against a replica of them whose bytes are damaged by
    rule and hashed again: some records have other bytes, some are cut short, the last of some
    archives is longer, and some archives are lost. Records keep the places that the archives'
    index gives them."""
    pages = merkle_audit.payloads(table(spark, sf_dir, "pages"))
    ours = written(merkle_audit.laid_out(merkle_audit.digests(pages)), "records")
    body = F.col("payload")
    damaged = (
        F.when(F.col("id") % 500 == 11, F.substring(body, 1, 100))
        .when(F.col("id") % 1000 == 999, F.concat(body, F.lit("more")))
        .when(F.col("id") % 50 == 7, F.concat(F.lit("#"), F.substring(body, 2, 1 << 30)))
        .otherwise(body)
    )
    found = merkle_audit.digests(pages.withColumn("payload", damaged))
    found = found.withColumnsRenamed({"archive": "in", "id": "of", "length": "n", "digest": "now"})
    place = ours.select("archive", "offset", "id")
    same = (F.col("archive") == F.col("in")) & F.col("id").eqNullSafe(F.col("of"))
    theirs = place.join(found, same).select(
        "archive", "offset", "id", F.col("n").alias("length"), F.col("now").alias("digest")
    )
    theirs = written(theirs.filter("archive % 20 != 19"), "replica")
    return merkle_audit.audit(ours, theirs)


ORACLE["op6_merkle_audit"] = """
WITH payload AS (
  SELECT page_id AS id, floor(page_id / 100)::BIGINT AS archive,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
         || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS p
  FROM pages
), placed AS (
  SELECT archive, id, strlen(p)::BIGINT AS length,
         coalesce(sum(strlen(p)) OVER (PARTITION BY archive ORDER BY id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM payload
)
SELECT archive, "offset", id, length,
       CASE WHEN archive % 20 = 19 THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE archive % 20 = 19 OR id % 500 = 11 OR id % 1000 = 999 OR id % 50 = 7
"""


@query
def op11_centroid_clustering(spark, sf_dir):
    return centroids.clusters_with_inertia(table(spark, sf_dir, "embeddings"))


ORACLE["op11_centroid_clustering"] = centroids.oracle_sql()


@query
def op12_source_divergence(spark, sf_dir):
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


ORACLE["op12_source_divergence"] = source_divergence.oracle_sql()


@query
def op13_pii_disclosure(spark, sf_dir):
    rows = disclosure.scan(table(spark, sf_dir, "documents"))

    def said(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*disclosure.KINDS))
    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in disclosure.KINDS],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
