"""Secret scans over content-addressed texts, with a ledger of what was scanned by which rules.

Every version of every path is a row (path, text). A text is known by its SHA-256, its blob. The
ledger is a table with one row per (blob, rule version): scanning a corpus again costs only the
blobs, or the rules, that are new, and copies of a text are scanned once. Findings are joined
back to all paths that hold the blob.
"""

import hashlib
import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rivertrack.llm.common import map_batches, whole_text, written

# kind -> (pattern, group whose length counts, least length), in the order that breaks ties.
# A match that is too short is dropped, but the text it covers is not searched again.
RULES = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 64),
    # only where its characters begin: a long run is then looked at once, not from every eyJ in it
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 24),
    "forge": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
}
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


def rule_version(rules=None):
    """Changes whenever a rule does."""
    return hashlib.sha256(json.dumps(rules or RULES).encode()).hexdigest()[:16]


def finder(rules=None):
    """text -> [(kind, start, end)] in code points, by start, then by the order of the rules."""
    compiled = [
        (place, kind, re.compile(pattern, re.ASCII), group, least)
        for place, (kind, (pattern, group, least)) in enumerate((rules or RULES).items())
    ]

    def find(text):
        found = [
            (m.start(), place, kind, m.end())
            for place, kind, pattern, group, least in compiled
            for m in pattern.finditer(text)
            if m.end(group) - m.start(group) >= least
        ]
        return [(kind, start, end) for start, _, kind, end in sorted(found)]

    return find


def _scan(blobs, rules):
    version = rule_version(rules)

    def start():
        find = finder(rules)

        def step(ids, texts):
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find(text)] for text in texts
            ]
            return ids, [version] * len(ids), spans

        return step

    return map_batches(blobs.select("blob", "_text"), LEDGER, start)


def read_ledger(spark, path):
    """The ledger's rows; an empty table while nothing was scanned."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def findings(spark, path, rules=None):
    """(blob, spans) of all blobs scanned by these rules, each once. Two writers that scan the same
    blob at the same time append it twice; what they found is the same."""
    rows = read_ledger(spark, path).filter(F.col("rule_version") == rule_version(rules))
    return rows.groupBy("blob").agg(F.first("spans").alias("spans"))


def _ledger_exists(spark, path):
    return bool(read_ledger(spark, path).take(1))


def with_blob(docs, text="text"):
    return docs.withColumn("blob", F.sha2(whole_text(text), 256))


def update_ledger(docs, ledger_path, text="text", rules=None):
    """Scan the blobs of ``docs`` that the ledger does not hold for these rules and append them.
    On a first run all texts go through one shuffle, copies merged before it; later, hashes find
    the unseen blobs and only their texts move. Appending is one atomic Spark write, so a failed
    run leaves no half-scanned blob behind."""
    spark = docs.sparkSession
    texts = docs.select(whole_text(text).alias("_text")).withColumn("blob", F.sha2("_text", 256))
    if _ledger_exists(spark, ledger_path):
        seen = read_ledger(spark, ledger_path).filter(F.col("rule_version") == rule_version(rules))
        unseen = texts.select("blob").distinct().join(seen.select("blob"), "blob", "left_anti")
        texts = texts.join(written(unseen, "unseen-blobs"), "blob", "left_semi")
    blobs = texts.groupBy("blob").agg(F.first("_text").alias("_text"))
    _scan(blobs, rules).write.mode("append").parquet(ledger_path)


def scan(docs, ledger_path, id_col="doc_id", text="text", rules=None):
    """One row (id, blob, spans) per row of ``docs``, after bringing the ledger up to date.

    Nulls: a null text counts as empty. Rows that repeat are answered each; a blob is scanned
    once. No rows, no answers. Other columns are not read."""
    update_ledger(docs, ledger_path, text, rules)
    found = findings(docs.sparkSession, ledger_path, rules)
    paths = docs.select(F.col(id_col), F.sha2(whole_text(text), 256).alias("blob"))
    return paths.join(found, "blob", "left").select(id_col, "blob", "spans")


MOST_BROADCAST = 200_000  # blobs with findings; about 100 bytes each


def redact(docs, ledger_path, text="text", mark="[secret]", rules=None):
    """``docs`` with every found span of the text replaced by ``mark``; same columns and rows.
    A null text stays null, and rows that repeat are answered each. A row travels as one struct, so
    that no name can clash. Only blobs with findings take part in the join; they are broadcast
    if they and their spans are few (counted), else joined by a shuffle."""
    spark = docs.sparkSession
    update_ledger(docs, ledger_path, text, rules)
    found = findings(spark, ledger_path, rules).filter(F.size("spans") > 0)
    size = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("spans")).alias("s")).first()
    if size.n + (size.s or 0) <= MOST_BROADCAST:
        found = F.broadcast(found)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), whole_text(text).alias("t"))
    rows = rows.withColumn("blob", F.sha2("t", 256)).join(found, "blob", "left")

    def piece(start, length=None):
        length = F.length("t") if length is None else length
        return F.substring(F.col("t"), (start + 1).cast("int"), length.cast("int"))

    # spans may overlap: a piece of text starts where all spans so far have ended
    step = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                F.when(s["start"] < acc["at"], acc["out"])
                .otherwise(F.concat(acc["out"], piece(acc["at"], s["start"] - acc["at"]), F.lit(mark)))
                .alias("out"),
                s["end"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], piece(acc["at"])),
    )
    said = F.col(f"row.`{text}`")
    masked = F.when((F.size("spans") > 0) & said.isNotNull(), step).otherwise(said)
    return rows.select(
        *[masked.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )
