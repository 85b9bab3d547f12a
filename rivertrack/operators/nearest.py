"""The nearest of many reference points, by a packed tree that is searched a batch at a time.

A tree holds boxes (points are boxes without extent) along a space-filling curve in groups of
``FAN``, these in groups again, and so on up. A search goes down level by level and keeps the
boxes that are not farther than some box is known to hold a point: some tens of comparisons per
level and position, however many points there are. Nearness of boxes and distances of points are
rounded alike, so a box is never farther than its points, and ties are found.

A layer that fits in a task is one tree, sent to all tasks. A larger one is cut into leaves of
neighbouring points, small where points are dense; the tree over the leaves' boxes is sent, and
positions meet the points of their leaf only, then those of the few leaves within reach.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivertrack.sources.files import stage_path, write_stage

FAN = 16
AT_ONCE = 8192  # positions searched together
ROUNDING = 1e-12  # share by which a radius may be rounded down
MOST_LEAVES = 100_000  # boxes sent to every task: 4 MB
PER_LEAF = 4096  # points of a leaf, more where the layer would have too many leaves
POSITIONS_PER_GROUP = 200_000  # positions that meet a leaf in one task


class PackedTree:
    """Boxes x0, y0, x1, y1, found again by their place in the arrays given. Of equally near
    ones the first is the nearest."""

    def __init__(self, x0, y0, x1=None, y1=None):
        x0, y0 = np.asarray(x0, "float64"), np.asarray(y0, "float64")
        boxes = np.stack([x0, y0, x0 if x1 is None else x1, y0 if y1 is None else y1], axis=1)
        middles = (boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3])
        self.order = np.argsort(_along_curve(*middles), kind="stable")
        self.levels = [_padded(boxes[self.order])]  # from the boxes up to at most FAN of them
        while len(self.levels[-1]) > FAN:
            groups = self.levels[-1].reshape(-1, FAN, 4)
            up = np.concatenate([groups[:, :, :2].min(axis=1), groups[:, :, 2:].max(axis=1)], axis=1)
            self.levels.append(_padded(up))
        self.compared = 0  # boxes that searches have looked at

    def __len__(self):
        return len(self.order)

    def _near_and_far(self, level, node, x, y):
        """For positions and the boxes of a group each: how near the box is, and within what
        distance it holds something for certain, as every side of it touches one of its own."""
        boxes = self.levels[level].reshape(-1, FAN, 4)[node]
        self.compared += boxes.shape[0] * FAN
        x0, x1 = boxes[:, :, 0] - x[:, None], x[:, None] - boxes[:, :, 2]
        y0, y1 = boxes[:, :, 1] - y[:, None], y[:, None] - boxes[:, :, 3]
        dx, dy = np.maximum(np.maximum(x0, x1), 0.0), np.maximum(np.maximum(y0, y1), 0.0)
        near = np.sqrt(dx * dx + dy * dy)
        x0, x1, y0, y1 = (np.abs(c) for c in (x0, x1, y0, y1))
        side_x = np.minimum(x0, x1) ** 2 + np.maximum(y0, y1) ** 2
        side_y = np.maximum(x0, x1) ** 2 + np.minimum(y0, y1) ** 2
        return near, np.sqrt(np.minimum(side_x, side_y))

    def _reach(self, x, y, radius=None):
        """(position, place in order, distance) of all boxes within each position's radius; if
        none is given, of the nearest boxes and some others."""
        shrink = radius is None
        radius = np.full(len(x), np.inf) if shrink else radius
        who = np.arange(len(x))
        node = np.zeros(len(x), dtype="int64")
        for level in range(len(self.levels) - 1, -1, -1):
            near, far = self._near_and_far(level, node, x[who], y[who])
            if shrink:
                starts = np.flatnonzero(np.r_[True, np.diff(who) != 0])
                sure = np.minimum.reduceat(far.min(axis=1), starts) * (1 + ROUNDING)
                radius[who[starts]] = np.minimum(radius[who[starts]], sure)
            hit, child = np.nonzero(near <= radius[who][:, None])
            distance = near[hit, child]
            who, node = who[hit], node[hit] * FAN + child
        return who, node, distance

    def _nearest(self, x, y):
        who, place, distance = self._reach(x, y)
        at = self.order[place]
        ranked = np.lexsort((at, distance, who))
        who, at, distance = who[ranked], at[ranked], distance[ranked]
        best = np.flatnonzero(np.r_[True, np.diff(who) != 0])
        return at[best], distance[best]

    def nearest(self, x, y):
        """(place, distance) of the nearest box of each position; the positions are finite."""
        parts = [
            self._nearest(x[i : i + AT_ONCE], y[i : i + AT_ONCE]) for i in range(0, len(x), AT_ONCE)
        ]
        if not parts:
            return np.empty(0, dtype="int64"), np.empty(0)
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def within(self, x, y, radius):
        """(position, place) of all boxes not farther than the position's radius."""
        parts = []
        for i in range(0, len(x), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            who, place, _ = self._reach(x[part], y[part], radius[part])
            parts.append((who + i, self.order[place]))
        if not parts:
            return (np.empty(0, dtype="int64"),) * 2
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _along_curve(x, y, bits=20):
    """Places along a Hilbert curve through the ranks of x and y, so that neighbours on it are
    neighbours in the plane, also where points are dense in some parts and sparse in others."""
    side = 1 << bits
    ranks = []
    for c in (x, y):
        _, rank = np.unique(c, return_inverse=True)
        ranks.append(rank * (side - 1) // max(1, int(rank.max(initial=0))))
    x, y = ranks
    place = np.zeros(len(x), dtype="int64")
    step = side >> 1
    while step:
        right, up = (x & step) > 0, (y & step) > 0
        place += step * step * ((3 * right) ^ up)
        turned = ~up & right
        x, y = np.where(turned, side - 1 - x, x), np.where(turned, side - 1 - y, y)
        x, y = np.where(up, x, y), np.where(up, y, x)
        step >>= 1
    return place


def _padded(boxes):
    """Filled up with boxes that are infinitely far."""
    out = np.full((-(-len(boxes) // FAN) * FAN, 4), np.inf)
    out[len(boxes) :, 2:] = -np.inf
    out[: len(boxes)] = boxes
    return out


def nearest_in_task(df: DataFrame, points: list) -> DataFrame:
    """Add ``_near`` (at, dist): the place of the nearest of ``points`` (in order of idx) for each
    row with a finite position. The rows stay where they are; only positions reach Python."""
    tree = PackedTree([p.x for p in points], [p.y for p in points])

    def nearest(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        xs, ys = x.to_numpy("float64", na_value=np.nan), y.to_numpy("float64", na_value=np.nan)
        known = np.isfinite(xs) & np.isfinite(ys)
        at, dist = np.zeros(len(xs), dtype="int64"), np.full(len(xs), np.nan)
        at[known], dist[known] = tree.nearest(xs[known], ys[known])
        out = pd.DataFrame({"at": pd.Series(at).where(known).astype("Int64"), "dist": dist})
        return out

    return df.withColumn("_near", F.pandas_udf(nearest, "at bigint, dist double")("x", "y"))


def packed_leaves(points: DataFrame, per_leaf: int = PER_LEAF) -> DataFrame:
    """Points (idx, x, y) with the ``leaf`` they belong to, written once: slices by x with as many
    points each, cut along y. A leaf has at most ``per_leaf`` points, or more if there would be
    more than ``MOST_LEAVES``."""
    n = points.count()
    per_leaf = max(per_leaf, -(-2 * n // MOST_LEAVES))
    slices = max(1, int((n / per_leaf) ** 0.5))
    ranged = points.repartitionByRange(slices, "x", "y", "idx")
    row = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    numbered = ranged.sortWithinPartitions("y", "x", "idx").withColumn("_row", row)
    place = F.col("_row").bitwiseAND(2**33 - 1)
    leaf = F.shiftleft(F.shiftright("_row", 33), 33) + F.floor(place / per_leaf)
    leaves = numbered.select("idx", "x", "y", leaf.alias("leaf"))
    return write_stage(leaves, stage_path(points.sparkSession, "leaves"))


def nearest_by_leaf(positions: DataFrame, points: DataFrame, per_leaf: int = PER_LEAF) -> DataFrame:
    """(x, y, idx, dist) of the nearest point (idx, x, y) of each position, for layers too large
    for a task. Two rounds, whatever the points are like: the nearest leaf gives a distance, and
    only leaves not farther than that can hold a nearer point."""
    spark = positions.sparkSession
    leaves = packed_leaves(points, per_leaf)
    low_high = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"]
    boxes = leaves.groupBy("leaf").agg(*low_high).orderBy("leaf").collect()
    tree = PackedTree(*zip(*[(b.min_x, b.min_y, b.max_x, b.max_y) for b in boxes], strict=True))
    names = np.array([b.leaf for b in boxes])

    def first_leaf(x: pd.Series, y: pd.Series) -> pd.Series:
        at, _ = tree.nearest(x.to_numpy("float64"), y.to_numpy("float64"))
        return pd.Series(names[at])

    def in_reach(x: pd.Series, y: pd.Series, dist: pd.Series) -> pd.Series:
        who, at = tree.within(*[c.to_numpy("float64") for c in (x, y, dist)])
        order = np.argsort(who, kind="stable")
        cuts = np.searchsorted(who[order], np.arange(1, len(x)))
        return pd.Series(np.split(names[at[order]], cuts) if len(x) else [])

    at_leaf = F.pandas_udf(first_leaf, "bigint")("x", "y")
    asked = positions.select("x", "y", at_leaf.alias("leaf"))
    asked = write_stage(asked, stage_path(spark, "positions"))
    first = write_stage(_meet(asked, leaves), stage_path(spark, "nearest"))
    others = F.explode(F.pandas_udf(in_reach, "array<bigint>")("x", "y", "dist")).alias("leaf")
    # nothing is asked twice of a leaf
    again = first.select("x", "y", "_leaf", others).where("leaf <> _leaf").drop("_leaf")
    found = first.drop("_leaf").unionByName(_meet(again, leaves).drop("_leaf"))
    best = found.groupBy("x", "y").agg(F.min(F.struct("dist", "idx")).alias("_best"))
    return best.select("x", "y", "_best.idx", "_best.dist")


def _meet(asked: DataFrame, leaves: DataFrame) -> DataFrame:
    """The nearest point of the given leaf for each (x, y, leaf). Positions of a leaf that many
    ask are spread over several groups, each with the leaf's points."""
    many = asked.groupBy("leaf").agg(
        F.ceil(F.count(F.lit(1)) / POSITIONS_PER_GROUP).cast("int").alias("_groups")
    )
    part = F.pmod(F.xxhash64("x", "y"), F.col("_groups")).cast("int").alias("_part")
    left = asked.join(F.broadcast(many), "leaf").select("leaf", "x", "y", part)
    all_parts = F.explode(F.sequence(F.lit(0), F.col("_all") - 1))
    right = leaves.join(F.broadcast(many.toDF("leaf", "_all")), "leaf").select(
        "leaf", "idx", "x", "y", all_parts.alias("_part")
    )

    def search(positions: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(positions):
            return pd.DataFrame({"x": [], "y": [], "idx": [], "dist": [], "_leaf": []})
        points = points.sort_values("idx", kind="stable")
        tree = PackedTree(points["x"].to_numpy(), points["y"].to_numpy())
        x, y = positions["x"].to_numpy(), positions["y"].to_numpy()
        at, dist = tree.nearest(x, y)
        idx = points["idx"].to_numpy()[at]
        return pd.DataFrame({"x": x, "y": y, "idx": idx, "dist": dist, "_leaf": positions["leaf"]})

    kind = leaves.schema["idx"].dataType.simpleString()
    return (
        left.groupBy("leaf", "_part")
        .cogroup(right.groupBy("leaf", "_part"))
        .applyInPandas(search, f"x double, y double, idx {kind}, dist double, _leaf bigint")
    )
