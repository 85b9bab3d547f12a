"""Positions: projection, nearest reference point, map extents, survey slices, layers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivertrack import constants as K
from rivertrack.functions.geo import utm_steps
from rivertrack.operators.nearest import PER_LEAF, nearest_by_leaf, nearest_in_task
from rivertrack.schema import fixed_table
from rivertrack.sources.files import write_stage


def project_utm(df: DataFrame, long: str = "long", lat: str = "lat") -> DataFrame:
    """Add ``x`` and ``y``, UTM zone 9 metres. The steps of the projection are columns of their
    own, each computed once, and the pair is a generated row: a filter on it is not pushed below
    and does not compute it again."""
    steps = utm_steps(long, lat)
    names = [name for step in steps[:-1] for name in step]
    out = df.drop("x", "y")
    for step in steps[:-1]:
        out = out.withColumns(step)
    pair = F.struct(*[c.alias(name) for name, c in steps[-1].items()])
    return out.select("*", F.inline(F.array(pair))).drop(*names)


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))  # NaN is above infinity


def nearest_reference_point(
    df: DataFrame, points: DataFrame, max_points: int = 20_000, per_leaf: int = PER_LEAF
) -> DataFrame:
    """Add idx, dist, and the other columns of the nearest point (lowest ``idx`` on ties).

    ``points`` (idx, x, y, ...) is a reference layer of one point per kilometre. Up to
    ``max_points`` are read to the driver and searched as a tree in every task; rows stay where
    they are. Of a larger layer, each distinct position meets the points of the leaves near it
    (see ``nearest``). Both agree. Rows whose position is missing or not finite get NULLs; points
    without a finite position are never nearest.
    """
    points = points.where(_finite("x") & _finite("y"))
    held = points.limit(max_points + 1).collect()
    if not held:
        raise ValueError("no reference points")
    more = [c for c in points.columns if c not in ("x", "y")]
    if len(held) <= max_points:
        held = sorted(held, key=lambda p: p.idx)
        fields = [points.schema[n] for n in more]
        table = T.StructType([T.StructField("_at", T.LongType()), *fields])
        rows = [(i, *[p[n] for n in more]) for i, p in enumerate(held)]
        payload = F.broadcast(fixed_table(df.sparkSession, rows, table))
        near = nearest_in_task(df, held).withColumns({"_at": F.col("_near.at"), "dist": F.col("_near.dist")})
        return near.join(payload, "_at", "left").select(*df.columns, "idx", "dist", *[c for c in more if c != "idx"])
    positions = df.where(_finite("x") & _finite("y")).select("x", "y").distinct()
    near = nearest_by_leaf(positions, points.select("idx", "x", "y"), per_leaf)
    near = near.join(points.drop("x", "y"), "idx")
    # rows without a position match nothing; spread, they do not all meet in one task
    spread = F.when(~(_finite("x") & _finite("y")), F.monotonically_increasing_id())
    rows = df.withColumn("_spread", F.coalesce(spread, F.lit(-1)))
    near = near.withColumn("_spread", F.lit(-1).cast("bigint"))
    return rows.join(near, ["x", "y", "_spread"], "left").select(
        *df.columns, "idx", "dist", *[c for c in more if c != "idx"]
    )


def bbox_membership(df: DataFrame, extents=tuple(K.MAP_EXTENTS)) -> DataFrame:
    """One row per point and map extent that contains it (borders included). The extents are a
    short fixed list, tested in place: no join."""
    boxes = [
        F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), F.lit(name))
        for name, x0, x1, y0, y1 in extents
    ]
    inside = F.filter(F.array(*boxes), lambda b: b.isNotNull())
    return df.withColumn("extent", F.explode(inside))


PLACE_BITS = 16  # of each coordinate in a place key
# masks that spread 16 bits over the even bits of 32, widest step first
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def place_key(extents=tuple(K.MAP_EXTENTS), x: str = "x", y: str = "y") -> Column:
    """A number whose order keeps neighbours in the plane together: the bits of both coordinates
    in turn, within the box around ``extents``. What lies outside counts as on its border; NULL
    without a position."""

    def spread(c: str, low: float, high: float) -> Column:
        share = (F.col(c) - low) / (high - low)
        bits = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (2**PLACE_BITS - 1))
        for step, mask in _SPREAD:
            bits = bits.bitwiseOR(F.shiftleft(bits, step)).bitwiseAND(F.lit(mask).cast("bigint"))
        return bits

    _, x0, x1, y0, y1 = zip(*extents)
    across, up = spread(x, min(x0), max(x1)), spread(y, min(y0), max(y1))
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.when(placed, across.bitwiseOR(F.shiftleft(up, 1)))


def write_by_place(
    df: DataFrame, path: str, extents=tuple(K.MAP_EXTENTS), files: int | None = None
) -> DataFrame:
    """Write points as a stage table in which each file, and each row group of a file, holds
    neighbours: a window on the map reads only the groups that it touches, by their smallest and
    largest coordinates. Rows of one place may be dealt over several files."""
    keyed = df.withColumn("_place", place_key(extents))
    order = [c for c in ("_place", "seq") if c in keyed.columns]
    dealt = keyed.repartitionByRange(*([files] if files else []), *order)
    return write_stage(dealt.sortWithinPartitions(*order).drop("_place"), path)


def in_extent(points: DataFrame, name: str, extents=tuple(K.MAP_EXTENTS)) -> DataFrame:
    """The points inside one map extent (borders included): on points as ``write_by_place`` wrote
    them, a filter that prunes what is read."""
    [(_, x0, x1, y0, y1)] = [e for e in extents if e[0] == name]
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    return points.where(inside).withColumn("extent", F.lit(name))


def survey_slices(det: DataFrame, dates=None) -> DataFrame:
    """Mobile rows with the number of their survey day, all days in one pass. ``dates`` lists
    the days; by default every day with a mobile row is one."""
    rows = det.where(F.col("method") == "Mobile")
    days = rows.select("date").distinct()
    if dates is not None:
        days = days.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    # one row per calendar day, so a few thousand at most: ranked in one task and broadcast
    numbered = days.withColumn("survey", F.row_number().over(Window.orderBy("date")))
    return rows.join(F.broadcast(numbered), "date")


def jitter_points(df: DataFrame, amount: float | Column, key: str = "seq") -> DataFrame:
    """Add ``x_jitter`` and ``y_jitter``, moved evenly within ``amount`` metres either way. The
    shift is a hash of ``key``, so a task run again draws the same."""
    amount = amount if isinstance(amount, Column) else F.lit(amount)

    def shift(salt: int) -> Column:
        named = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(salt)))
        # the first 13 hexadecimal digits of the hash, as a number from 0 to 1
        digits = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double")
        return (digits / float(2**52) * 2 - 1) * amount

    return df.withColumns(
        {"x_jitter": F.col("x") + shift(1), "y_jitter": F.col("y") + shift(2)}
    )


def vertex_attribute_join(
    vertices: DataFrame, attributes: DataFrame, keep: Column, on: str = "id"
) -> DataFrame:
    """Vertices of the features whose attributes pass ``keep``; the filter runs first."""
    return vertices.join(attributes.where(keep), on)
