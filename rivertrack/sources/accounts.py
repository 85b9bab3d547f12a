"""Every line of a download is accounted for: counted while it is scanned, by what becomes of it."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class LostLines(RuntimeError):
    """A scan's lines and what was written of them do not add up."""


class LineAccount:
    """What becomes of the lines of some files, counted by the scans themselves.

    The scan that writes the records and the one that writes the rejects each count all lines by
    kind as they pass. ``check`` holds the two against each other, and the rejects against the
    rows written. A task that ran again after a lost executor may have been counted twice, so
    counts that do not add up are taken afresh from the files before the run fails.
    """

    def __init__(self, kept: str = "kept", rejected: str = "rejected"):
        self.kept, self.rejected = kept, rejected
        self._seen: dict[str, tuple[Observation, DataFrame, dict[str, Column]]] = {}

    def watch(self, scan: str, lines: DataFrame, kinds: dict[str, Column]) -> DataFrame:
        """``lines``, counted by kind when they are next read by an action. Each line must be of
        one kind."""
        seen = Observation()
        self._seen[scan] = seen, lines, kinds
        return lines.observe(seen, *self._counts(kinds))

    @staticmethod
    def _counts(kinds: dict[str, Column]) -> list[Column]:
        every = F.count(F.lit(1)).alias("lines")
        return [every, *[F.count_if(c).alias(name) for name, c in kinds.items()]]

    def counts(self, scan: str) -> dict[str, int]:
        """Of a scan that an action has read."""
        return dict(self._seen[scan][0].get)

    def _afresh(self, scan: str) -> dict[str, int]:
        _, lines, kinds = self._seen[scan]
        return lines.agg(*self._counts(kinds)).first().asDict()

    def _fault(self, found: dict[str, dict[str, int]], written: int) -> str | None:
        for scan, n in found.items():
            kinds = self._seen[scan][2]
            if n["lines"] != sum(n[k] for k in kinds):
                return f"{scan}: {n} leaves lines out"
        if len({tuple(sorted(n.items())) for n in found.values()}) > 1:
            return f"scans differ: {found}"
        rejected = next(iter(found.values()))[self.rejected]
        if rejected != written:
            return f"{rejected} lines were rejected, {written} were written"
        return None

    def check(self, written: int) -> dict[str, int]:
        """The counts, if they add up with ``written``, the rows kept of rejected lines."""
        fault = self._fault({scan: self.counts(scan) for scan in self._seen}, written)
        if fault is None:
            return self.counts(next(iter(self._seen)))
        afresh = {scan: self._afresh(scan) for scan in self._seen}
        again = self._fault(afresh, written)
        if again is not None:
            raise LostLines(f"{fault}; counted afresh: {again}")
        return next(iter(afresh.values()))
