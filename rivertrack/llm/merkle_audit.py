"""Fixity audit of archive files: hash trees over records, compared between replicas.

A record is (archive, offset, length, digest). Records whose offsets start in one range of LEAF
bytes make a leaf, FANOUT nodes in order a node, up to one root per archive; a node's hash covers
its children's places and hashes. Two replicas are compared at the roots; only the children of
nodes that differ are looked at, down to the records that are changed, missing or new. Nodes are
groups of bounded size: FANOUT children, or the records that start within one leaf range.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivertrack.llm.common import written

LEAF = 1 << 16  # bytes
FANOUT = 16
PER_ARCHIVE = 100  # consecutive page ids
NO_ID = 4096  # archives that records without an id are dealt over, numbered from -1 down


def _response(url, body):
    """A WARC response record around a body."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages, id_col="page_id", url="url", body="html", per_archive=PER_ARCHIVE):
    """The records (archive, id, length, digest) that ``pages`` make, without offsets. Null url
    or body is an empty one; rows with a null id are dealt over ``NO_ID`` archives by digest."""
    return digests(payloads(pages, id_col, url, body, per_archive))


def payloads(pages, id_col="page_id", url="url", body="html", per_archive=PER_ARCHIVE):
    """The bytes of the records: (archive, id, payload)."""
    none = F.lit("")
    payload = _response(F.coalesce(F.col(url), none), F.coalesce(F.col(body), none))
    dealt = -1 - F.pmod(F.xxhash64("payload"), F.lit(NO_ID))
    archive = F.coalesce(F.floor(F.col("id") / per_archive).cast("long"), dealt)
    rows = pages.select(F.col(id_col).alias("id"), payload.alias("payload"))
    return rows.select(archive.alias("archive"), "id", "payload")


def digests(rows):
    """(archive, id, length, digest) of payloads."""
    length = F.octet_length("payload").cast("long")
    return rows.select("archive", "id", length.alias("length"), F.sha2("payload", 256).alias("digest"))


def laid_out(rows):
    """Records with their offsets: by id within the archive, equal ids by digest. The window holds
    lengths and digests only, and an archive is a bounded number of ids."""
    order = Window.partitionBy("archive").orderBy("id", "digest")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)))


def _node(place):
    children = F.array_sort(F.collect_list(F.struct(place, "digest")))
    said = F.transform(children, lambda c: F.concat_ws(":", c[place], c["digest"]))
    return F.sha2(F.array_join(said, "\n"), 256).alias("digest")


def tree(rows):
    """All nodes (archive, level, node, digest); level 0 are the leaves. The highest level is the
    one at which every archive is a single node."""
    leaf = rows.withColumn("node", F.floor(F.col("offset") / LEAF).cast("long"))
    leaf = leaf.withColumn("place", F.format_string("%020d:%d", "offset", "length"))
    level = written(leaf.groupBy("archive", "node").agg(_node("place")), "merkle-level")
    levels = [level.select("archive", F.lit(0).alias("level"), "node", "digest")]
    most = level.agg(F.max("node")).first()[0] or 0
    while most:
        up = level.withColumns({"place": F.format_string("%020d", "node"), "node": F.floor(F.col("node") / FANOUT).cast("long")})
        level = written(up.groupBy("archive", "node").agg(_node("place")), "merkle-level")
        levels.append(level.select("archive", F.lit(len(levels)).alias("level"), "node", "digest"))
        most //= FANOUT
    return reduce(lambda a, b: a.unionByName(b), levels), len(levels) - 1


def _differing(ours, theirs, keys):
    """Rows of either side (keys, digest, theirs) whose digests differ or that one side lacks."""
    both = ours.join(theirs.withColumnRenamed("digest", "other"), keys, "full")
    return both.filter(~F.col("digest").eqNullSafe(F.col("other")))


def audit(ours, theirs):
    """Rows (archive, offset, id, length, status) of records that differ between two tables of
    laid-out records: ``changed``, ``missing`` (in theirs) or ``extra``.

    Equal tables, and empty ones, give no rows. An archive only one side has differs as a whole;
    records are matched by offset, so after a record of another length all later ones differ.
    Records repeated at one offset are compared by their smallest digest."""
    (a, top), (b, top_b) = tree(ours), tree(theirs)
    top = max(top, top_b)
    suspects = None
    for level in range(top, -1, -1):
        sides = []
        for nodes in (a, b):
            part = nodes.filter(F.col("level") == level).select("archive", "node", "digest")
            if suspects is not None:
                part = part.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long"))
                part = part.join(suspects, ["archive", "parent"], "left_semi").drop("parent")
            sides.append(part)
        differ = _differing(*sides, ["archive", "node"])
        suspects = written(differ.select("archive", F.col("node").alias("parent")), "merkle-suspects")
    found = []
    for rows in (ours, theirs):
        part = rows.withColumn("parent", F.floor(F.col("offset") / LEAF).cast("long"))
        part = part.join(suspects, ["archive", "parent"], "left_semi")
        least = F.min(F.struct("digest", "id", "length"))
        found.append(part.groupBy("archive", "offset").agg(least.alias("r")).select("archive", "offset", "r.*"))
    mine, other = found
    other = other.withColumnsRenamed({"digest": "other", "id": "other_id", "length": "other_length"})
    both = mine.join(other, ["archive", "offset"], "full")
    both = both.filter(~F.col("digest").eqNullSafe(F.col("other")))
    status = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra")
    return both.select(
        "archive", "offset", F.coalesce("id", "other_id").alias("id"),
        F.coalesce("length", "other_length").alias("length"), status.otherwise("changed").alias("status"),
    )
