"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import functions as F

from rivertrack.llm.common import dropped, written


def _least(edges, near, far):
    """Per ``near``: the least of it and its neighbours. Combined before the shuffle."""
    return edges.groupBy(near).agg(F.least(F.col(near), F.min(far)).alias("m"))


def _both(edges):
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges):
    both = _both(edges)
    out = both.join(_least(both, "a", "b"), "a").filter("b > a")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")


def _small_star(edges):
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, "a", "b")
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b")


def _state(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    return tuple(row.first())


def components(links):
    """Rows (vertex, component), the component being its least vertex, for every vertex of
    ``links`` (a, b). Every round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path, and the driver sees two numbers a round. A vertex
    with many links is combined before the shuffle, and its join is split at run time."""
    edges = written(links.filter("a != b").select("a", "b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        older, edges = edges, written(_small_star(_large_star(edges)).distinct(), "links")
        dropped(older)
        before, state = state, _state(edges)
        if state == before:
            break
    member = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    centre = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return member.unionByName(centre)
