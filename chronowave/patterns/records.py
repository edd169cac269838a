"""Match results as an ordered table: by position, by slice, by status."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .runner import PatternError

STATUSES = ("OK", "Timeout", "RequireViolated")


class MatchRecords:
    """The rows of ``match``, ordered by trace and start. Nothing runs before rows are asked for."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _sorted(self, falling: bool = False) -> DataFrame:
        order = [F.col("trace"), F.col("start.index")]
        return self.df.orderBy(*[c.desc() for c in order] if falling else order)

    # -- columns ---------------------------------------------------------------------------------------------------
    @property
    def ok(self) -> Column:
        """1 for each match that ended well."""
        return (F.col("status.kind") == "OK").cast("bigint")

    @property
    def failed(self) -> Column:
        return (F.col("status.kind") != "OK").cast("bigint")

    @property
    def duration(self) -> Column:
        return F.col("duration")

    def with_flags(self) -> DataFrame:
        return self.df.withColumns({"ok": self.ok, "failed": self.failed})

    # -- rows by status --------------------------------------------------------------------------------------------
    def filter_ok(self) -> MatchRecords:
        return self.filter_status("OK")

    def filter_failed(self) -> MatchRecords:
        return MatchRecords(self.df.where(F.col("status.kind") != "OK"))

    def filter_status(self, kind: str) -> MatchRecords:
        if kind not in STATUSES:
            raise TypeError(f"a status is one of {STATUSES}")
        return MatchRecords(self.df.where(F.col("status.kind") == kind))

    # -- rows by place ---------------------------------------------------------------------------------------------
    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[Row]:
        return iter(self._sorted().toLocalIterator())

    def __getitem__(self, key: int | slice) -> Row | MatchRecords:
        """One row (IndexError past the ends), or the records of a slice; a negative place counts from the end."""
        if isinstance(key, slice):
            if key.step not in (None, 1):
                raise PatternError("slices of matches have no step")
            first, last = key.start or 0, key.stop
            if first < 0 or (last is not None and last < 0):
                n = len(self)
                first, last, _ = key.indices(n)
            rows = self._sorted().offset(first)
            return MatchRecords(rows if last is None else rows.limit(max(0, last - first)))
        if isinstance(key, bool) or not isinstance(key, int):
            raise TypeError("a place is an integer or a slice")
        found = self._sorted(key < 0).offset(-key - 1 if key < 0 else key).limit(1).collect()
        if not found:
            raise IndexError(key)
        return found[0]
