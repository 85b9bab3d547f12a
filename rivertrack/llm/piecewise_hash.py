"""Context-triggered piecewise hashing: fingerprints that stay alike when a text is edited.

A rolling hash of the last seven bytes ends a chunk wherever its low bits are all ones, so chunk
ends move with the text. Each chunk adds one character to the signature. The block size, the
mean length of a chunk, is a power of two that follows the length of the text, and is doubled while
a text that repeats itself has too many ends for it; a second signature is taken at twice that
size. Every byte is in a chunk of both, and both are bounded. Two fingerprints are compared at a block size both have, by edit distance.
"""

import hashlib
import zlib
from os.path import commonprefix

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from rivertrack.llm.common import map_batches, whole_text

WINDOW = 7
CHUNKS = 64  # the block size is the least power of two of which this many cover the text
MOST_CHUNKS = 4096  # of a signature; texts that do not repeat themselves have some 64 to 128
RUN = 4  # signatures without a common run of this length are unlike
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PART = 1 << 22  # bytes hashed at a time


def _rolling(data):
    """A hash of the WINDOW bytes up to each position (fewer at the start)."""
    c = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    h = c.copy()
    for k in range(1, min(WINDOW, len(c))):
        h[k:] += c[:-k] * np.uint32(pow(0x01000193, k, 1 << 32))
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(8)


def _ends(data):
    """(block size, chunk ends, their hashes). Long texts are hashed part by part."""
    block = 1
    while block * CHUNKS < len(data):
        block *= 2
    mask = np.uint32(block - 1)
    at, hashes = [], []
    for a in range(0, len(data), _PART):
        lead = min(a, WINDOW - 1)
        h = _rolling(data[a - lead : a + _PART])[lead:]
        hits = np.flatnonzero(h & mask == mask)
        at.append(hits + a + 1)
        hashes.append(h[hits])
    if not at:
        return block, np.zeros(0, np.int64), np.zeros(0, np.uint32)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    while len(at) >= MOST_CHUNKS:
        block *= 2
        mask = np.uint32(block - 1)
        kept = hashes & mask == mask
        at, hashes = at[kept], hashes[kept]
    return block, at, hashes


def _signature(data, ends):
    """One letter per chunk."""
    cuts = [0, *ends.tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    pairs = zip(cuts, cuts[1:], strict=False)
    return "".join(_LETTERS[zlib.crc32(data[a:b]) & 63] for a, b in pairs)


def fingerprint(data):
    """``block:signature:signature at twice the block size`` of some bytes."""
    block, at, hashes = _ends(data)
    mask = np.uint32(2 * block - 1)
    return f"{block}:{_signature(data, at)}:{_signature(data, at[hashes & mask == mask])}"


def edit_distance(a, b):
    """Levenshtein distance, one column of the table per character of ``b`` in a few integer
    operations (bit-parallel). What both start and end with costs nothing and is left out."""
    same = len(commonprefix((a, b)))
    a, b = a[same:], b[same:]
    same = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a:
        return len(b)
    where = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for x in b:
        eq = where.get(x, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diag | up) & full, up & diag
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(diag | plus) & full, plus & diag
    return score


def _alike(a, b):
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or not {a[i : i + run] for i in range(len(a) - run + 1)}.intersection(
        b[i : i + run] for i in range(len(b) - run + 1)
    ):
        return 0.0
    return 1 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a, b):
    """0 to 1: 1 for equal fingerprints, 0 if no block size is common to both."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_alike(a1, b1), _alike(a2, b2))
    if n == 2 * m:
        return _alike(a1, b2)
    return _alike(a2, b1) if m == 2 * n else 0.0


def fingerprints(docs, id_col="doc_id", text="text"):
    """One row (id, n_chars, fingerprint) per row of ``docs``, without a shuffle. A null text
    counts as empty; its fingerprint is ``1::``. Equal texts have equal fingerprints."""

    def start():
        def step(keys, texts):
            texts = [t or "" for t in texts]
            return keys, list(map(len, texts)), [fingerprint(t.encode()) for t in texts]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars bigint, fingerprint string"
    return map_batches(docs.select(id_col, text), schema, start)


def with_next(docs, id_col="doc_id", text="text"):
    """Rows (id, text, copy) in partitions by id range, each sorted by descending id, such that
    every row's successor in that order (after the last: the first) is the next in its
    partition: the first row of a range is also sent to the end of the range above it, marked
    ``copy``. One shuffle of the texts. The driver sees one id per partition.

    Rows of one id are ordered by a hash of the text; a null id comes last."""
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = F.lit(-(2**63)).cast("long")
    rows = docs.select(
        F.col(id_col), whole_text(text).alias("_text"),
        F.coalesce(F.col(id_col).cast("long"), lowest).alias("_order"),
    ).withColumn("_tie", F.xxhash64("_text"))
    shares = [i / count for i in range(1, count)] or [0.5]
    cuts = rows.agg(F.percentile_approx("_order", shares, 100_000).alias("c")).first().c or []
    cuts = sorted({float(c) for c in cuts}) or [0.0]
    splits = [-float("inf"), *cuts, float("inf")]
    placed = rows.withColumn("_double", F.col("_order").cast("double"))
    placed = Bucketizer(splits=splits, inputCol="_double", outputCol="_bucket").transform(placed)
    placed = placed.withColumn("_part", F.col("_bucket").cast("int"))
    first = placed.groupBy("_part").agg(F.max(F.struct("_order", "_tie")).alias("h")).collect()
    first = sorted((r["_part"], r.h["_order"], r.h["_tie"]) for r in first)
    # a range's first row also ends the next range above; the first of all ends the lowest
    to = {order: (first[(i + 1) % len(first)][0], tie) for i, (_, order, tie) in enumerate(first)}
    heads = spark.createDataFrame(
        [(order, part, tie) for order, (part, tie) in to.items()],
        "_head long, _to int, _head_tie long",
    )
    marked = placed.join(
        F.broadcast(heads),  # one row per range
        (F.col("_order") == F.col("_head")) & (F.col("_tie") == F.col("_head_tie")),
        "left",
    )
    own = F.struct(F.col("_part").alias("part"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("_to").alias("part"), F.lit(1).alias("copy"))
    sent = F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy)))
    dealt = marked.withColumn("_s", sent).select(id_col, "_text", "_order", "_tie", "_s.part", "_s.copy")
    return (
        dealt.repartitionById(len(splits) - 1, F.col("part"))
        .sortWithinPartitions("copy", F.desc("_order"), F.desc("_tie"))
        .select(id_col, F.col("_text").alias("text"), "copy")
    )


def edited(text, following):
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of
    ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_chain(docs, id_col="doc_id", text="text"):
    """Each document beside its edited text and beside the next document by descending id: one
    row (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    per row of ``docs``. A null text counts as empty; one document is its own successor; equal
    rows follow each other. Other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        last = []

        def compare(key, text, mark, following, next_mark):
            new = edited(text, following).encode()
            new_mark = fingerprint(new)
            return (
                key, len(text), hashlib.sha256(new).hexdigest(), mark, new_mark,
                likeness(mark, new_mark), likeness(mark, next_mark),
            )

        def step(keys, texts, copies):
            out = []
            for key, text, copy in zip(keys, texts, copies, strict=True):
                if copy and not last:
                    continue  # a repeated first row was sent twice
                mark = fingerprint(text.encode())
                if last:
                    out.append(compare(*last, text, mark))
                last[:] = [] if copy else [key, text, mark]
            return list(zip(*out, strict=True))

        return step

    schema = (
        f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return map_batches(with_next(docs, id_col, text), schema, start)
