"""The cleaning cascade over the union of fixed, mobile and tagging rows.

For short tags the whole chain is one shuffle by tag: every window partitions by it. Long tags
(see ``timeline.slice_hot_tags``) go through the same steps on slices, and only their rows are
written to the checkpoint folder between steps.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.operators.cleaning import (
    gap_gate,
    movement_rates,
    strongest_mobile,
    terminal_zone_lock,
)
from rivertrack.operators.lookups import stations, tagging_events
from rivertrack.operators.rules import exclude
from rivertrack.operators.speed import speed_filter
from rivertrack.operators.timeline import (
    SLICE,
    Clustered,
    hot_rows,
    is_sliced,
    settle,
    slice_hot_tags,
    unslice,
)
from rivertrack.schema import conform
from rivertrack.sources.files import write_clustered, write_stage

# order of the sources within one instant of one tag
SOURCE_SHIFT = 1 << 60


def unified_timeline(fixed: DataFrame, mobile: DataFrame, tags: DataFrame) -> DataFrame:
    """Canonical union of the three sources. ``seq`` keeps each source's own order, and puts
    fixed before mobile before tagging rows of the same instant."""
    parts = []
    for i, part in enumerate([fixed, mobile, tagging_events(tags)]):
        if "seq" not in part.columns:
            part = part.withColumn("seq", F.lit(0).cast("bigint"))
        parts.append(conform(part.withColumn("seq", F.col("seq") + F.lit(i * SOURCE_SHIFT))))
    return reduce(DataFrame.unionByName, parts)


def with_station_positions(fixed: DataFrame) -> DataFrame:
    """Fixed rows take their station's position."""
    table = stations(fixed.sparkSession).select("station", "lat", "long")
    return fixed.drop("lat", "long").join(F.broadcast(table), "station", "left")


def _chain(
    out: DataFrame,
    early_rules: DataFrame | None = None,
    late_rules: DataFrame | None = None,
    zones=tuple(K.TERMINAL_ZONES),
    min_gap: float = K.PULSE_SECONDS,
    lost_gap: float = K.LOST_GAP_SECONDS,
    lost_tolerance: float = 0.0,
    remove_impossible: bool = False,
    max_distance: float = K.MAX_DISTANCE_RKM,
    max_rate: float = K.MAX_RATE_RKM_PER_DAY,
) -> DataFrame:
    out = settle(gap_gate(out, min_gap, lost_gap, lost_tolerance))
    if early_rules is not None:
        out = exclude(out, early_rules)
    for zone in zones:
        out = settle(terminal_zone_lock(out, zone))
    if late_rules is not None:
        out = exclude(out, late_rules)
    if remove_impossible:
        out = settle(speed_filter(out, max_distance, max_rate))
    out = settle(movement_rates(out))
    return unslice(strongest_mobile(out, clustered=True))


def cleaning_cascade(
    det: DataFrame | Clustered, *rules, rows_per_slice: int | None = 2_000_000, **options
) -> DataFrame:
    """Gap gate and lost-tag flag, early rules, terminal zones in turn, late rules, movement
    rates, strongest mobile row per day: ``rules`` and ``options`` as ``_chain`` has them. The
    late rules are the hand-made form of removing impossible moves; ``remove_impossible`` runs
    the described procedure as well. Rows that lie clustered by tag are not shuffled."""
    if isinstance(det, Clustered):
        return det.per_tag(lambda part: _chain(part, *rules, **options))
    rows = det if rows_per_slice is None else slice_hot_tags(det, rows_per_slice)
    if not is_sliced(rows):
        return _chain(rows, *rules, **options)
    # tags are independent: the short ones stay one shuffle, only the long ones are written
    parts = Clustered(unslice(rows.where(F.col(SLICE).isNull())), settle(hot_rows(rows)))
    return cleaning_cascade(parts, *rules, **options)


def clean_clustered(det: Clustered, path: str, *rules, **options) -> Clustered:
    """``cleaning_cascade`` from one clustered stage table to the next. The cleaned rows lie as
    they did, so neither the windows nor the writing shuffles short tags."""
    short = write_clustered(_chain(det.short, *rules, **options), f"{path}/short")
    if det.long is None:
        return Clustered(short)
    return Clustered(short, write_stage(_chain(det.long, *rules, **options), f"{path}/long"))
