"""Centroid clustering in integers, with a filter in rotated coordinates.

Vectors are turned into integers once and stored beside their coordinates along the leading
principal axes and the length of what these leave out. For a vector and a centroid, the squared
distance of the leading coordinates plus the squared difference of the two lengths is never above
their squared distance, so a centroid whose bound lies above a distance already found is out. The
ones that survive are compared in integers: results do not depend on the axes, which are fitted
on a bounded sample, nor on rounding.

A round reads the stored table once and sends one row per task and cluster; what reaches the
driver is one row per cluster. Nulls: a vector that is null, has another number of components, or
a component that is null, not finite or too large for a 64-bit integer once scaled, is not kept. A
vector without an id is clustered like any other, but is a first centroid only if there are too
few others. Rows that repeat count each. Fewer kept vectors than clusters: each is a first
centroid. No kept vector: no rows. A distance or sum beyond 64 bits is null. Other columns are
not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rivertrack.llm.common import written
from rivertrack.schema import fixed_table

COMPONENTS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED_PREFIX = "2:"
LEADING = 16  # stored rotated coordinates
SAMPLE = 4096  # vectors the axes are fitted on; they decide what is compared, not the result
SMALL = 2**27  # up to this size, squared distances of COMPONENTS components fit in 64 bits
LARGEST = 2**63 - 1
SLACK = 1e-9  # of the squared lengths; rounding in the bounds is below 1e-12 of them
LIMB = 32  # sums leave a task as two 64-bit halves, so that none overflows


def kept_vectors(df, id_col="vec_id", vector="embedding"):
    """(id, vector) of the rows that can be clustered."""
    x = F.col(vector)
    whole = F.forall(
        x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(2**62 // SCALE))
    )
    rows = df.where((F.size(x) == COMPONENTS) & whole)
    return rows.select(F.col(id_col).alias("id"), x.cast("array<double>").alias("vector"))


def _integers(column):
    """Components of a list column as integers, one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype("int64").reshape(-1, COMPONENTS)


class Axes:
    """The leading principal axes of some vectors, and how vectors look along them."""

    def __init__(self, sample):
        x = np.asarray(sample, dtype="float64").reshape(-1, COMPONENTS)
        self.mean = x.mean(axis=0)
        _, turned = np.linalg.eigh(np.cov((x - self.mean).T, bias=True))
        self.leading = turned[:, ::-1][:, :LEADING]

    def turn(self, vectors):
        """(leading coordinates, length of the rest)"""
        x = vectors.astype("float64") - self.mean
        lead = x @ self.leading
        return lead, np.sqrt(((x - lead @ self.leading.T) ** 2).sum(axis=1))


def squared_distances(vectors, others):
    """Exact, also where 64 bits do not hold them."""
    if max(_size(vectors), _size(others)) > SMALL:
        vectors, others = vectors.astype(object), others.astype(object)
    gap = vectors - others
    return (gap * gap).sum(axis=1)


def _size(vectors):
    return max(abs(int(vectors.max())), abs(int(vectors.min()))) if vectors.size else 0


def nearest(vectors, lead, rest, centroids, axes):
    """(number of the nearest centroid, the smaller number on ties; squared distance)"""
    c_lead, c_rest = axes.turn(centroids)
    own, c_own = (lead**2).sum(axis=1), (c_lead**2).sum(axis=1)
    bound = own[:, None] + c_own - 2 * (lead @ c_lead.T) + (rest[:, None] - c_rest) ** 2
    bound -= SLACK * ((own + rest**2)[:, None] + c_own + c_rest**2)
    at = bound.argmin(axis=1)
    best = squared_distances(vectors, centroids[at])
    for k in range(len(centroids)):
        rows = np.flatnonzero((bound[:, k] <= best) & (at != k))
        far = squared_distances(vectors[rows], centroids[k][None, :])
        if far.dtype != best.dtype:
            best = best.astype(object)
        nearer = (far < best[rows]) | ((far == best[rows]) & (k < at[rows]))
        best[rows[nearer]], at[rows[nearer]] = far[nearer], k
    return at, best


def _stored(rows, axes):
    """Integers, leading coordinates and the length of the rest, written once."""
    schema = T.StructType(
        [
            rows.schema["id"],
            *T.StructType.fromDDL("v array<bigint>, lead array<double>, rest double").fields,
        ]
    )
    arrow = to_arrow_schema(schema)

    def lists(matrix):
        ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype="int32")
        return pa.ListArray.from_arrays(ends, matrix.ravel())

    def run(batches):
        for batch in batches:
            v = _integers(batch.column(1))
            lead, rest = axes.turn(v)
            parts = [batch.column(0), lists(v), lists(lead), pa.array(rest)]
            columns = [c.cast(f.type) for c, f in zip(parts, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return written(rows.mapInArrow(run, schema), "rotated-vectors")


def _matrix(column, width, kind):
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _answers(batch, centroids, axes):
    v = _matrix(batch.column("v"), COMPONENTS, "int64")
    lead = _matrix(batch.column("lead"), LEADING, "float64")
    rest = batch.column("rest").to_numpy(zero_copy_only=False)
    return v, *nearest(v, lead, rest, centroids, axes)


def _next_centroids(stored, centroids, axes):
    """The floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    schema = "cluster int, n bigint, high array<bigint>, low array<bigint>"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        sums = np.zeros((len(centroids), COMPONENTS), dtype=object)
        counts = np.zeros(len(centroids), dtype="int64")
        for batch in batches:
            v, at, _ = _answers(batch, centroids, axes)
            if _size(v) > SMALL:
                v = v.astype(object)
            for k in np.unique(at):
                mine = v[at == k]
                sums[k] += mine.sum(axis=0).astype(object)
                counts[k] += len(mine)
        seen = np.flatnonzero(counts)
        columns = [
            seen.astype("int32"),
            counts[seen],
            [[int(x) >> LIMB for x in sums[k]] for k in seen],
            [[int(x) & (2**LIMB - 1) for x in sums[k]] for k in seen],
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
        )

    parts = stored.select("v", "lead", "rest").mapInArrow(run, schema)
    halves = [F.sum(F.col(half)[i]) for half in ("high", "low") for i in range(COMPONENTS)]
    out = centroids.copy()
    for k, n, *sums in parts.groupBy("cluster").agg(F.sum("n"), *halves).collect():
        high, low = sums[:COMPONENTS], sums[COMPONENTS:]
        out[k] = [((h << LIMB) + x) // n for h, x in zip(high, low, strict=True)]
    return out


def cluster(df, id_col="vec_id", vector="embedding", clusters=CLUSTERS, rounds=ROUNDS):
    """(id, cluster, distance) of every kept vector, and the final centroids."""
    rows = kept_vectors(df, id_col, vector)
    drawn = F.sha2(F.concat(F.lit(SEED_PREFIX), F.col("id").cast("string")), 256)
    sample = rows.orderBy(drawn.asc_nulls_last(), "vector").limit(max(SAMPLE, clusters)).collect()
    kind = rows.schema["id"].dataType
    result = T.StructType(
        [T.StructField("id", kind), *T.StructType.fromDDL("cluster int, distance bigint").fields]
    )
    if not sample:
        return df.sparkSession.createDataFrame([], result), []
    first = np.floor(np.array([r.vector for r in sample]) * SCALE).astype("int64")
    axes = Axes(first)
    stored = _stored(rows, axes)
    centroids = first[:clusters]
    for _ in range(rounds):
        centroids = _next_centroids(stored, centroids, axes)
    arrow = to_arrow_schema(result)

    def run(batches):
        for batch in batches:
            _, at, best = _answers(batch, centroids, axes)
            if best.dtype == object:
                best = [int(x) if x <= LARGEST else None for x in best]
            columns = [batch.column("id"), pa.array(at, pa.int32()), pa.array(best, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return written(stored.mapInArrow(run, result), "clusters"), centroids.tolist()


def clusters_with_inertia(df, id_col="vec_id", vector="embedding"):
    """``cluster`` with what each cluster and the whole add up to, and each centroid's hash."""
    found, centroids = cluster(df, id_col, vector)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    unknown = F.count_if(F.col("distance").isNull())
    sums = found.groupBy("cluster").agg(total.alias("sum"), unknown.alias("unknown")).collect()
    per = {r.cluster: None if r.unknown else int(r.sum) for r in sums}
    whole = None if None in per.values() else sum(per.values())

    def long(x):
        return x if x is not None and x <= LARGEST else None

    said = [",".join(map(str, c)) for c in centroids]
    table = [
        (k, long(x), long(whole), hashlib.sha256(said[k].encode()).hexdigest())
        for k, x in sorted(per.items())
    ]
    more = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    known = F.broadcast(fixed_table(df.sparkSession, table, more))
    return found.join(known, "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle_sql():
    """The same clustering in DuckDB's SQL, every distance in integers."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c
  FROM embeddings WHERE len(embedding) = {COMPONENTS}
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), x AS MATERIALIZED (
  SELECT r, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM v
), first AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED_PREFIX}' || vec_id), c) - 1 AS k, r FROM v
), c0 AS MATERIALIZED (
  SELECT k, i, x FROM first JOIN x USING (r) WHERE k < {CLUSTERS}
)"""
    ]
    for n in range(ROUNDS + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, (min(d * {CLUSTERS} + k) % {CLUSTERS})::INTEGER AS k, min(d)::BIGINT AS d
  FROM (SELECT x.r, c.k, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{n} c USING (i)
        GROUP BY x.r, c.k) GROUP BY r
)"""
        )
        if n < ROUNDS:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.x)::BIGINT AS x
  FROM c{n} c LEFT JOIN (SELECT a.k, x.i, sum(x.x) AS s, count(*) AS n
                         FROM a{n} a JOIN x USING (r) GROUP BY a.k, x.i) s USING (k, i)
)"""
            )
    last = ROUNDS
    parts.append(
        f"""h AS (
  SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k
)"""
    )
    return "WITH " + ", ".join(parts) + f"""
SELECT v.vec_id, a.k AS cluster, a.d AS distance,
       (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{last} a JOIN v USING (r) JOIN h USING (k)
"""
