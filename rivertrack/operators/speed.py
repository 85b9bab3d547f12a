"""Removal of impossible moves until none is left.

"Drop the first impossible move of each tag, recompute, repeat" keeps a row unless its move
from the *last kept* row is impossible, so one pass in time order gives the fixed point. Only
that last kept row is remembered: rows stream through the task in Arrow batches and no group is
ever held whole. A long tag's slices are folded side by side, each from the row its predecessor
kept last, which maps of whole slices tell beforehand (see ``speed_filter``).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rivertrack import constants as K
from rivertrack.functions.times import MICROS_PER_DAY, micros
from rivertrack.operators.cleaning import is_impossible
from rivertrack.operators.timeline import (
    SLICE,
    hot_rows,
    is_sliced,
    settle,
    timeline,
    timeline_keys,
)

_HELPERS = ["_us", "_first", "_bad", "_start_us", "_start_rkm"]


def _in_order(df: DataFrame, max_distance: float, max_rate: float) -> DataFrame:
    """Each (tag, slice) in order, with ``_us``, ``_first`` (its first row) and ``_bad`` (reached by
    an impossible move from the row before)."""
    w = timeline(df)
    return (
        # plain columns in the window, so that nothing extra is shuffled
        df.withColumns(
            {
                "_prev_ts": F.lag("ts").over(w),
                "_prev_rkm": F.lag("rkm").over(w),
                "_first": F.row_number().over(w) == 1,
            }
        )
        .withColumn("_us", micros("ts"))
        .withColumn(
            "_bad",
            F.coalesce(
                is_impossible(
                    F.abs(F.col("rkm") - F.col("_prev_rkm")),
                    (F.col("_us") - micros("_prev_ts")) / float(MICROS_PER_DAY),
                    max_distance,
                    max_rate,
                ),
                F.lit(False),
            ),
        )
        .drop("_prev_ts", "_prev_rkm")
        # already the order the window leaves behind; stated, not relied on
        .sortWithinPartitions(*timeline_keys(df), "ts", "seq")
    )


def _columns(batch):
    """Times (0 where there is none), whether there is one, kilometres, first rows, bad rows."""
    us = batch.column("_us")
    return (
        us.fill_null(0).to_numpy(zero_copy_only=False),
        us.is_valid().to_numpy(zero_copy_only=False),
        batch.column("rkm").to_numpy(zero_copy_only=False).astype("float64"),
        batch.column("_first").to_numpy(zero_copy_only=False),
        batch.column("_bad").to_numpy(zero_copy_only=False),
    )


def _fold(df: DataFrame, max_distance: float, max_rate: float) -> DataFrame:
    """Fold each (tag, slice), from (``_start_us``, ``_start_rkm``) where given."""
    rows = _in_order(df, max_distance, max_rate)
    kept = T.StructType([f for f in rows.schema.fields if f.name not in _HELPERS])
    day = float(MICROS_PER_DAY)

    def keep_reachable(batches):
        import numpy as np
        import pyarrow as pa

        clean = True  # the row before the current one was kept
        last_us, last_rkm = None, float("nan")  # the last kept row

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            # a row without a time is always reachable, and so is the row after it
            us, timed, rkm, first, bad = _columns(batch)
            start_us = batch.column("_start_us")
            start_rkm = batch.column("_start_rkm").to_numpy(zero_copy_only=False)
            stops = np.flatnonzero(first | bad)
            keep = np.ones(n, dtype=bool)
            i = 0
            while i < n:
                if clean:
                    # every row up to the next group start or impossible move is kept
                    s = np.searchsorted(stops, i)
                    stop = int(stops[s]) if s < len(stops) else n
                    if stop > i:
                        last_us = int(us[stop - 1]) if timed[stop - 1] else None
                        last_rkm = float(rkm[stop - 1])
                    i = stop
                    if i == n:
                        break
                if first[i]:
                    given = start_us[i].as_py()
                    last_us = given  # without a time, as without a start, the row is kept
                    last_rkm = float("nan") if given is None else float(start_rkm[i])
                gap = abs(float(rkm[i]) - last_rkm)  # NaN compares false: kept
                known = timed[i] and last_us is not None
                far = known and gap > max_distance and gap > (int(us[i]) - last_us) / day * max_rate
                if far:
                    keep[i] = False
                else:
                    last_us, last_rkm = int(us[i]) if timed[i] else None, float(rkm[i])
                clean = not far
                i += 1
            kept_rows = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [kept_rows.column(name) for name in kept.names], names=kept.names
            )

    return rows.mapInArrow(keep_reachable, kept)


def _fresh(df: DataFrame) -> DataFrame:
    return df.withColumn("_start_us", F.lit(None).cast("bigint")).withColumn(
        "_start_rkm", F.lit(None).cast("double")
    )


def _is_far(last, us, rkm, max_distance: float, max_rate: float) -> bool:
    """Whether (us, rkm) cannot be reached from ``last``; a missing time or place can."""
    gap = abs(rkm - last[1])  # NaN compares false
    return (
        us is not None
        and last[0] is not None
        and gap > max_distance
        and gap > (us - last[0]) / float(MICROS_PER_DAY) * max_rate
    )


class EntryMap:
    """What a slice makes of any row its timeline may have kept last before it.

    A start enters a slice at the first row it can reach. Rows of one place that follow each
    other are one run: whoever enters at one of them has kept the last of them. So the slice is a
    list of runs, each with its last time and with the row kept last by whoever enters there; a
    start that reaches none passes through. The list ends at the first row that is reachable from
    every place between ``low`` and ``high`` at any time before the slice. All entries are folded
    in one pass: two that keep the same row are one from there on.
    """

    def __init__(self, low: float, high: float, max_distance: float, max_rate: float):
        self.low, self.high, self.limits = low, high, (max_distance, max_rate)
        self.runs: list[list] = []  # [rkm, last µs]
        self.states: list[list] = []  # [µs, rkm, runs that entered into it]
        self.open = True
        self.began = self.before = None

    def settled(self) -> bool:
        """All entries have met, and no more can come."""
        return not self.open and len(self.states) == 1

    def _reachable_from_anywhere(self, us, rkm) -> bool:
        if us is None or self.began is None or rkm != rkm:
            return True
        furthest = self.low if abs(rkm - self.low) > abs(rkm - self.high) else self.high
        return not _is_far((self.began, furthest), us, rkm, *self.limits)

    def add(self, us, rkm) -> None:
        """The next row of the slice."""
        if not self.runs:
            self.began = us
        entered, others = [], []
        for state in self.states:
            if _is_far(state, us, rkm, *self.limits):
                others.append(state)
            else:
                entered += state[2]
        if self.open:
            if self.runs and self.before == rkm:
                self.runs[-1][1] = us
            else:
                entered.append(len(self.runs))
                self.runs.append([rkm, us])
            self.open = not self._reachable_from_anywhere(us, rkm)
        self.before = rkm
        self.states = [*others, [us, rkm, entered]] if entered else others

    def exits(self) -> list[tuple]:
        """(rkm, last µs, exit µs, exit rkm) of each run, in order."""
        of = {run: state for state in self.states for run in state[2]}
        return [(rkm, us, of[i][0], of[i][1]) for i, (rkm, us) in enumerate(self.runs)]


def leave(start, runs, max_distance: float, max_rate: float):
    """The row kept last after a slice that is entered with ``start`` (µs, rkm) or with none."""
    for rkm, until, exit_us, exit_rkm in runs:
        if start is None or not _is_far(start, until, rkm, max_distance, max_rate):
            return exit_us, exit_rkm
    return start


_RUNS = "array<struct<rkm: double, until: bigint, exit_us: bigint, exit_rkm: double>>"


def _entry_maps(hot: DataFrame, max_distance: float, max_rate: float) -> DataFrame:
    """(tag, slice, runs): the entry map of each slice, in one pass over rows in order."""
    rkm = F.col("rkm").cast("double")
    low, high = hot.where(~F.isnan(rkm)).agg(F.min(rkm), F.max(rkm)).first()
    rows = _in_order(hot, max_distance, max_rate).select("tag", SLICE, "_us", "rkm", "_first", "_bad")
    schema = T.StructType(
        [hot.schema["tag"], hot.schema[SLICE], *T.StructType.fromDDL(f"runs {_RUNS}").fields]
    )
    arrow = to_arrow_schema(schema)

    def summarise(batches):
        import numpy as np
        import pyarrow as pa

        key, entries = None, None

        def out():
            said = [dict(zip(("rkm", "until", "exit_us", "exit_rkm"), r)) for r in entries.exits()]
            columns = [[key[0]], [key[1]], [said]]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            us, timed, rkm, first, bad = _columns(batch)
            stops = np.flatnonzero(first | bad)
            i = 0
            while i < batch.num_rows:
                if first[i]:
                    if entries is not None:
                        yield out()
                    key = batch.column("tag")[i].as_py(), batch.column(SLICE)[i].as_py()
                    entries, clean = EntryMap(low, high, max_distance, max_rate), False
                elif clean and entries.settled():
                    # one fold is left, and it keeps every row up to the next impossible move
                    s = np.searchsorted(stops, i)
                    stop = int(stops[s]) if s < len(stops) else batch.num_rows
                    if stop > i:
                        i = stop - 1
                        entries.states[0][:2] = int(us[i]) if timed[i] else None, float(rkm[i])
                        i += 1
                        continue
                at = int(us[i]) if timed[i] else None
                entries.add(at, float(rkm[i]))
                clean = entries.states[-1][:2] == [at, float(rkm[i])]
                i += 1
        if entries is not None:
            yield out()

    return rows.mapInArrow(summarise, schema)


def _slice_starts(maps: DataFrame, max_distance: float, max_rate: float) -> DataFrame:
    """(tag, slice, _start_us, _start_rkm): the row each slice is entered with. The maps of one
    tag, one row per slice, are gone through in order."""
    schema = T.StructType(
        [
            maps.schema["tag"],
            maps.schema[SLICE],
            *T.StructType.fromDDL("_start_us bigint, _start_rkm double").fields,
        ]
    )

    def chain(slices):
        import pandas as pd

        start, starts = None, []
        for runs in slices.sort_values(SLICE)["runs"]:
            starts.append(start or (None, None))
            start = leave(start, [tuple(r.values()) for r in runs], max_distance, max_rate)
        out = slices.sort_values(SLICE)[["tag", SLICE]]
        out["_start_us"] = pd.array([None if t is None else int(t) for t, _ in starts], dtype="Int64")
        out["_start_rkm"] = [None if r is None else float(r) for _, r in starts]
        return out

    return maps.groupBy("tag").applyInPandas(chain, schema)


def speed_filter(
    df: DataFrame,
    max_distance: float = K.MAX_DISTANCE_RKM,
    max_rate: float = K.MAX_RATE_RKM_PER_DAY,
) -> DataFrame:
    """Keep the rows a tag could have reached from its last kept row; a row without a time or a
    place is kept.

    Unsliced: one pass. Sliced: one pass makes of every slice a map from the row it may be entered
    with to the row it leaves as the last one kept (see ``EntryMap``), the maps of a tag are gone
    through in order, and a second pass folds all slices side by side, each from its start. Two
    passes, however many slices there are.
    """
    if not is_sliced(df):
        folded = _fold(_fresh(df), max_distance, max_rate)
        return folded.select(*df.columns)

    short = _fold(_fresh(df.where(F.col(SLICE).isNull())), max_distance, max_rate)
    hot = settle(hot_rows(df))  # read twice
    starts = _slice_starts(_entry_maps(hot, max_distance, max_rate), max_distance, max_rate)
    # one row per slice
    long = _fold(hot.join(F.broadcast(starts), ["tag", SLICE], "left"), max_distance, max_rate)
    return short.select(*df.columns).unionByName(long.select(*df.columns))
