"""Filters and selections. All of them keep clock and time and count positions anew."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Frame, Wave


def _only(wave: Wave, name: str = "value") -> Frame:
    return Frame(wave.to_df(name), {name: (wave.width, wave.signed)})


def mask(wave: Wave, by: Wave) -> Frame:
    """Samples where a one-bit wave is 1."""
    frame = wave.frame.with_column(__keep=by.one_bit(), value=wave.column)
    return Frame(frame.df, {"value": (wave.width, wave.signed)}).where(F.col("__keep"))


def filter_values(wave: Wave, predicate: Callable[[Column], Column]) -> Frame:
    return _only(wave).where(predicate(F.col("value")))


def vectorized_filter(wave: Wave, func: Callable[[np.ndarray], np.ndarray]) -> Frame:
    """Samples where a NumPy function of a batch of values is true; it must not look across samples."""

    @F.pandas_udf("boolean")
    def keep(s: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(func(s.to_numpy()), dtype=bool))

    return _only(wave).with_column(__keep=keep(F.col("value"))).where(F.col("__keep"))


def time_slice(frame: Frame, begin: int | None = None, end: int | None = None, include_end: bool = False) -> Frame:
    """``begin <= time < end``; the filter reaches the scan where time is a stored column."""
    return frame.where(_between("time", begin, end, include_end))


def cycle_slice(frame: Frame, begin: int | None = None, end: int | None = None, include_end: bool = False) -> Frame:
    return frame.where(_between("clock", begin, end, include_end))


def index_slice(frame: Frame, begin: int | None = None, end: int | None = None, include_end: bool = False) -> Frame:
    """By position; negative positions count from a trace's end."""
    if (begin or 0) < 0 or (end or 0) < 0:
        n = F.count(F.lit(1)).over(frame.whole())
        at = lambda x: n + x if x is not None and x < 0 else None if x is None else F.lit(x)
        marked = frame.with_column(__b=at(begin) if begin is not None else F.lit(0), __e=at(end) if end is not None else n)
        stop = F.col("idx") <= F.col("__e") if include_end and end is not None else F.col("idx") < F.col("__e")
        return marked.where((F.col("idx") >= F.col("__b")) & stop)
    return frame.where(_between("idx", begin, end, include_end))


def _between(name: str, begin: int | None, end: int | None, include_end: bool) -> Column:
    out = F.lit(True)
    if begin is not None:
        out = out & (F.col(name) >= begin)
    if end is not None:
        out = out & (F.col(name) <= end if include_end else F.col(name) < end)
    return out


def take(frame: Frame, positions: Sequence[int]) -> Frame:
    """Samples by position, in the order given, repeats included; negative positions count from the end."""
    if any(isinstance(p, bool) or not isinstance(p, int) for p in positions):
        raise TypeError("positions are integers")
    wanted = frame.df.sparkSession.createDataFrame([(i, p) for i, p in enumerate(positions)] or [], "pos long, want long")
    counted = frame.df.withColumn("__n", F.count(F.lit(1)).over(frame.whole())) if any(p < 0 for p in positions) else frame.df.withColumn("__n", F.lit(0))
    joined = counted.join(F.broadcast(wanted), F.col("idx") == F.when(F.col("want") < 0, F.col("want") + F.col("__n")).otherwise(F.col("want")))  # as long as the argument
    return Frame(joined.withColumn("idx", F.col("pos")).drop("pos", "want", "__n"), frame.columns)


def unique_consecutive(wave: Wave) -> Frame:
    """The first sample of each run of equal values."""
    before = F.lag("value").over(wave.frame.window())
    return _only(wave).with_column(__k=before.isNull() | (before != F.col("value"))).where(F.col("__k"))


def compress(wave: Wave) -> Frame:
    """Run starts, and each trace's last sample."""
    w = wave.frame.window()
    before, after = F.lag("value").over(w), F.lead("idx").over(w)
    return _only(wave).with_column(__k=before.isNull() | (before != F.col("value")) | after.isNull()).where(F.col("__k"))
