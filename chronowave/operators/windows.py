"""Window operators: edges, shifts, count windows, and analyses of runs. One sort per trace serves them all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frame import Frame, Wave
from ..functions.integers import Int


def _edge(wave: Wave, before: int, now: int) -> Wave:
    wave.one_bit()
    prev = F.lag(wave.column).over(wave.frame.window())
    return wave.like(Int(F.coalesce((prev == before) & (wave.column == now), F.lit(False)).cast("bigint"), 0, 1), 1, False)


def rising_edge(wave: Wave) -> Wave:
    return _edge(wave, 0, 1)


def falling_edge(wave: Wave) -> Wave:
    return _edge(wave, 1, 0)


def relative(wave: Wave, offset: int, pad: str = "repeat", pad_value: float | None = None) -> Wave:
    """The value ``offset`` samples later; past the ends the end's value, or ``pad_value``."""
    if pad not in ("repeat", "value") or (pad == "value") != (pad_value is not None):
        raise ValueError("pad is 'repeat', or 'value' with a pad_value")
    w, whole = wave.frame.window(), wave.frame.whole()
    n, at = F.count(F.lit(1)).over(whole), F.col("idx") + offset
    inside = (at >= 0) & (at < n)
    moved = F.lead(wave.column, offset).over(w) if offset >= 0 else F.lag(wave.column, -offset).over(w)
    fill = F.lit(pad_value) if pad == "value" else (F.last(wave.column) if offset > 0 else F.first(wave.column)).over(whole)
    value = F.when(inside, moved).otherwise(fill)
    return wave.like(Int(value.cast("bigint"), min(wave.int.lo, int(pad_value or 0)), max(wave.int.hi, int(pad_value or 0))) if wave.int is not None and wave.int.narrow else value, wave.width, wave.signed)


def ahead(wave: Wave, n: int = 1, **pad) -> Wave:
    return relative(wave, n, **pad)


def back(wave: Wave, n: int = 1, **pad) -> Wave:
    return relative(wave, -n, **pad)


def downsample(wave: Wave, chunk: int, func: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Tumbling windows of ``chunk`` samples, the last may be shorter; clock and time are means."""
    cell = F.floor(F.col("idx") / chunk).cast("bigint").alias("idx")
    return wave.to_df().groupBy("trace", cell).agg(func("value").alias("value"), F.avg("clock").alias("clock"), F.avg("time").alias("time"))


def downsample_by(wave: Wave, chunk: int, func: Callable[[np.ndarray], float] = np.mean) -> DataFrame:
    """``downsample`` by any function of a window's values, in order; windows hold at most ``chunk`` values, so their arrays are
    bounded. Prefer ``downsample``, which runs in the JVM and combines partial windows."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: float(func(np.asarray(x))))

    cell = F.floor(F.col("idx") / chunk).cast("bigint").alias("idx")
    windows = wave.to_df().groupBy("trace", cell).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("i"), "value"))).alias("v"), F.avg("clock").alias("clock"), F.avg("time").alias("time"))
    return windows.select("trace", "idx", run(F.col("v.value")).alias("value"), "clock", "time")


def run_lengths(wave: Wave) -> DataFrame:
    """Runs of ones of a one-bit wave: the k-th rise paired with the k-th fall, both by rank. Runs cut by an end are left out."""
    edges = wave.frame.with_waves(__r=rising_edge(wave), __f=falling_edge(wave)).df
    rank = F.row_number().over(W.partitionBy("trace").orderBy("idx"))
    rise = edges.where("__r = 1").select("trace", rank.alias("k"), F.col("clock").alias("rise"))
    fall = edges.where("__f = 1").select("trace", rank.alias("k"), F.col("clock").alias("fall"))
    return rise.join(fall, ["trace", "k"]).select("trace", "k", "rise", "fall", (F.col("fall") - F.col("rise") + 1).alias("length"))


def scoreboard(frame: Frame, write: Column, written: Column, read: Column, got: Column) -> DataFrame:
    """The k-th write against the k-th read of a trace, as far as both go; read data is taken one sample later."""
    rank = F.row_number().over(W.partitionBy("trace").orderBy("idx"))
    base = frame.df.select("trace", "idx", write.alias("w"), written.alias("x"), read.alias("r"), F.lead(got).over(frame.window()).alias("y"))
    a = base.where("w").select("trace", rank.alias("k"), "x")
    b = base.where("r").select("trace", rank.alias("k"), "y")
    return a.join(b, ["trace", "k"]).select("trace", "k", "x", "y", (F.col("x") == F.col("y")).alias("same"))
