"""Frames of signals sampled on one clock, and waves: width- and sign-aware expressions over a frame.

A frame is a DataFrame (trace, idx, clock, time, signals...). ``trace`` is the partition key of everything; ``idx`` counts the
samples of a trace from 0. Operators build columns; nothing runs before the result is asked for, and all waves of a frame
meet in one projection.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import integers as I
from .functions.integers import Int

if TYPE_CHECKING:
    import numpy as np

AXIS = ("trace", "idx", "clock", "time")
_names = itertools.count()


class Frame:
    """Signals on one clock axis. ``columns``: name -> (width, signed)."""

    def __init__(self, df: DataFrame, columns: dict[str, tuple[int | None, bool]]):
        self.df, self.columns = df, dict(columns)

    @staticmethod
    def from_table(df: DataFrame, trace: str | Column, order: Sequence[str], time: Column, signals: dict[str, tuple[Column, int | None, bool]]) -> Frame:
        """A frame from any event table: samples of a trace are numbered by ``order``."""
        key = F.col(trace) if isinstance(trace, str) else trace
        base = df.select(key.alias("trace"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], time.cast("bigint").alias("time"), *[c.alias(n) for n, (c, _, _) in signals.items()])
        number = F.row_number().over(W.partitionBy("trace").orderBy(*[f"__o{i}" for i in range(len(order))])).cast("bigint") - 1
        out = base.withColumn("idx", number).select("trace", "idx", F.col("idx").alias("clock"), "time", *signals)
        return Frame(out, {n: (w, s) for n, (_, w, s) in signals.items()})

    @staticmethod
    def from_arrays(spark: SparkSession, signals: dict[str, Sequence[Any]], widths: dict[str, int | None] | None = None, signed: Sequence[str] = (), clock: Sequence[int] | None = None, time: Sequence[int] | None = None, trace: Any = 0) -> Frame:
        """A frame of one trace from Python lists of equal length; width 1 where none is given."""
        n = len(next(iter(signals.values())))
        if any(len(v) != n for v in signals.values()):
            raise ValueError("signals differ in length")
        clock = list(range(n)) if clock is None else list(clock)
        time = [10 * c for c in clock] if time is None else list(time)
        widths = {**dict.fromkeys(signals, 1), **(widths or {})}
        kind = lambda name: "double" if any(isinstance(x, float) for x in signals[name]) else I.DECIMAL if (widths[name] or 0) > 63 else "bigint"
        schema = "trace long, idx long, clock long, time long, " + ", ".join(f"`{name}` {kind(name)}" for name in signals)
        from decimal import Decimal

        cast = lambda name, x: Decimal(x) if kind(name) == I.DECIMAL else x
        rows = [(trace, i, clock[i], time[i], *[cast(name, v[i]) for name, v in signals.items()]) for i in range(n)]
        return Frame(spark.createDataFrame(rows, schema), {name: (widths[name], name in signed) for name in signals})

    def window(self):
        return W.partitionBy("trace").orderBy("idx")

    def whole(self):
        return self.window().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def __getitem__(self, name: str) -> Wave:
        width, signed = self.columns[name]
        if width is None:
            return Wave(self, F.col(name), None, signed)
        if signed:
            return Wave(self, Int(F.col(name), -(1 << 63), (1 << 63) - 1), width, True)
        return Wave(self, Int(F.col(name), 0, (1 << width) - 1), width, False)

    def with_waves(self, **waves: Wave) -> Frame:
        """This frame with further signals computed from waves of it, in one projection."""
        for w in waves.values():
            if w.frame is not self:
                raise ValueError("waves of other frames are joined with align() first")
        df = self.df.withColumns({n: w.column for n, w in waves.items()})
        return Frame(df, {**self.columns, **{n: (w.width, w.signed) for n, w in waves.items()}})

    def where(self, condition: Column, renumber: bool = True) -> Frame:
        """The samples that fulfil a condition; clock and time stay, positions are counted anew."""
        df = self.df.where(condition)
        if renumber:
            df = df.withColumn("idx", F.row_number().over(self.window()).cast("bigint") - 1)
        return Frame(df, self.columns)

    def with_column(self, **columns: Column) -> Frame:
        return Frame(self.df.withColumns(columns), self.columns)

    def align(self, other: Frame) -> Frame:
        """Both frames' signals by position; clock and time are this frame's. Lengths must agree per trace."""
        twice = set(self.columns) & set(other.columns)
        if twice:
            raise ValueError(f"both frames have {sorted(twice)}")
        right = other.df.select("trace", "idx", *other.columns, F.lit(1).alias("__r"))
        joined = self.df.withColumn("__l", F.lit(1)).join(right, ["trace", "idx"], "full")
        same = F.col("__l").isNotNull() & F.col("__r").isNotNull()
        checked = joined.withColumn("idx", F.when(same, F.col("idx")).otherwise(F.raise_error(F.lit("waves differ in length")).cast("bigint")))
        return Frame(checked.select(*AXIS, *self.columns, *other.columns), {**self.columns, **other.columns})


def scalar_width(x: Any) -> int | None:
    if isinstance(x, bool) or isinstance(x, int):
        return int(x).bit_length()
    if isinstance(x, float):
        return None
    raise ValueError(f"unsupported operand {x!r}")


class Wave:
    """A column over a frame with a width (None: not an integer of known width) and a sign."""

    def __init__(self, frame: Frame, value: Int | Column, width: int | None, signed: bool, name: str | None = None):
        self.frame, self.width, self.signed = frame, width, signed
        self.int = value if isinstance(value, Int) else None
        self.column: Column = value.col if isinstance(value, Int) else value
        self.name = name or f"__w{next(_names)}"

    def __reduce__(self):
        from .patterns.runner import WaveRef

        return WaveRef, (self.name, self.width)

    __hash__ = object.__hash__

    # -- results ---------------------------------------------------------------------------------------------------
    def to_df(self, name: str = "value") -> DataFrame:
        return self.frame.df.select(*AXIS, self.column.alias(name))

    def head_tail(self, n: int = 5) -> DataFrame:
        """The first and last ``n`` samples of each trace, for display."""
        w = self.frame.window()
        ends = self.to_df().withColumn("__n", F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        return ends.where((F.col("idx") < n) | (F.col("idx") >= F.col("__n") - n)).drop("__n")

    def rows(self) -> list:
        """The values in order, for small results."""
        return [r[0] if not hasattr(r[0], "as_tuple") else int(r[0]) for r in self.to_df().orderBy("trace", "idx").select("value").collect()]

    def like(self, value: Int | Column, width: int | None, signed: bool) -> Wave:
        return Wave(self.frame, value, width, signed)

    def with_meta(self, width: int | None = None, signed: bool | None = None) -> Wave:
        return Wave(self.frame, self.int or self.column, self.width if width is None else width, self.signed if signed is None else signed)

    def copy(self) -> Wave:
        return self.like(self.int or self.column, self.width, self.signed)

    # -- operands --------------------------------------------------------------------------------------------------
    def _operand(self, other: Any) -> tuple[Int | Column, int | None]:
        if isinstance(other, Wave):
            if other.frame is not self.frame:
                raise ValueError("waves of different frames are joined with Frame.align() first")
            if other.signed != self.signed:
                raise ValueError("signedness differs")
            return other.int or other.column, other.width
        width = scalar_width(other)
        return (F.lit(float(other)) if width is None else Int.of(int(other))), width

    def _float(self) -> Column:
        return self.column.cast("double")

    def _arith(self, other: Any, op: Callable, width: Callable, reverse: bool = False, floats: Callable | None = None) -> Wave:
        value, w = self._operand(other)
        if self.int is None or not isinstance(value, Int):
            right = value.col if isinstance(value, Int) else value
            a, b = (right.cast("double"), self._float()) if reverse else (self._float(), right.cast("double"))
            return self.like(floats(a, b), None, self.signed)
        a, b = (value, self.int) if reverse else (self.int, value)
        out = None if self.width is None or w is None else width(self.width, w)
        return self.like(op(a, b), out, self.signed)

    def __add__(self, other: Any) -> Wave:
        if max(self.width or 0, other.width or 0 if isinstance(other, Wave) else 0) > 64:
            raise ValueError("addition takes at most 64 bits")
        return self._arith(other, lambda a, b: I.add(a, b, self.signed), lambda a, b: min(max(a, b) + 1, 64), floats=lambda a, b: a + b)

    __radd__ = __add__

    def __sub__(self, other: Any) -> Wave:
        return self._arith(other, lambda a, b: I.add(a, b, self.signed, -1), lambda a, b: min(max(a, b), 64), floats=lambda a, b: a - b)

    def __rsub__(self, other: Any) -> Wave:
        return self._arith(other, lambda a, b: I.add(a, b, self.signed, -1), lambda a, b: min(max(a, b), 64), True, lambda a, b: a - b)

    def __mul__(self, other: Any) -> Wave:
        return self._arith(other, lambda a, b: I.multiply(a, b, self.signed), lambda a, b: min(a + b, 64), floats=lambda a, b: a * b)

    __rmul__ = __mul__

    def _ratio(self, other: Any, reverse: bool) -> Wave:
        value, _ = self._operand(other)
        right = (value.col if isinstance(value, Int) else value).cast("double")
        a, b = (right, self._float()) if reverse else (self._float(), right)
        by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        return self.like(F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b)), None, self.signed)

    def __truediv__(self, other: Any) -> Wave:
        return self._ratio(other, False)

    def __rtruediv__(self, other: Any) -> Wave:
        return self._ratio(other, True)

    def __floordiv__(self, other: Any) -> Wave:
        return self._arith(other, lambda a, b: I.divide(a, b, self.signed)[0], lambda a, _: min(a, 64), floats=lambda a, b: F.floor(a / b).cast("double"))

    def __rfloordiv__(self, other: Any) -> Wave:
        return self._arith(other, lambda a, b: I.divide(a, b, self.signed)[0], lambda _, b: min(b, 64), True, lambda a, b: F.floor(a / b).cast("double"))

    def __mod__(self, other: Any) -> Wave:
        return self._arith(other, lambda a, b: I.divide(a, b, self.signed)[1], lambda a, _: min(a, 64), floats=lambda a, b: a - F.floor(a / b) * b)

    def __rmod__(self, other: Any) -> Wave:
        return self._arith(other, lambda a, b: I.divide(a, b, self.signed)[1], lambda _, b: min(b, 64), True, lambda a, b: a - F.floor(a / b) * b)

    def __pow__(self, n: int | Wave) -> Wave:
        """A power by a constant, or by a wave of at most four bits (one case for each exponent)."""
        if isinstance(n, Wave):
            value, w = self._operand(n)
            if w is None or w > 4 or self.int is None:
                raise NotImplementedError("exponents of more than four bits")
            powers = [I.power(self.int, k, self.signed) for k in range(1 << w)]
            cases = F.lit(None).cast(I.DECIMAL)
            for k, p in enumerate(powers):
                cases = F.when(value.col == k, p.as_(False)).otherwise(cases)
            out = Int(cases, min(p.lo for p in powers), max(p.hi for p in powers))
            return self.like(Int(out.as_(out.narrow), out.lo, out.hi), 64, self.signed)
        if not isinstance(n, int) or n < 0 or self.int is None:
            raise TypeError("powers take a constant, non-negative integer")
        return self.like(I.power(self.int, n, self.signed), 64, self.signed)

    # -- bits ------------------------------------------------------------------------------------------------------
    def _bits(self, other: Any, name: str) -> Wave:
        if isinstance(other, float):
            raise TypeError("bit operators take integers")
        if self.width is None or self.int is None:
            raise ValueError("bit operators need a width")
        value, w = self._operand(other)
        if isinstance(other, Wave) and w != self.width:
            raise ValueError("widths differ")
        if not isinstance(other, Wave) and w > self.width:
            raise ValueError("the constant is wider than the signal")
        if self.width > 64:  # 63 low bits and the rest, each by itself
            low, high = (other[62:0], other[self.width - 1 : 63]) if isinstance(other, Wave) else (int(other) & ((1 << 63) - 1), int(other) >> 63)
            return Wave.concatenate([self[62:0]._bits(low, name), self[self.width - 1 : 63]._bits(high, name)])
        return self.like(Int.unsigned(getattr(self.int.pattern(), name)(value.pattern()), self.width if not self.signed else 64), self.width, False)

    def __and__(self, other: Any) -> Wave:
        return self._bits(other, "bitwiseAND")

    def __or__(self, other: Any) -> Wave:
        return self._bits(other, "bitwiseOR")

    def __xor__(self, other: Any) -> Wave:
        return self._bits(other, "bitwiseXOR")

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def __invert__(self) -> Wave:
        if self.width is None:
            raise ValueError("inversion needs a width")
        top = Int.of((1 << self.width) - 1)
        return self.like(I.add(top, I.low_bits(self.int, self.width), False, -1), self.width, False)

    def __lshift__(self, n: int | Wave) -> Wave:
        if isinstance(n, Wave):
            value, w = self._operand(n)
            if self.width + (1 << w) > 126:
                raise NotImplementedError("values past 126 bits")
            cases = F.lit(None).cast(I.DECIMAL)
            for k in range(1 << w):
                cases = F.when(value.col == k, I.shift_left(self.int, k, self.signed).as_(False)).otherwise(cases)
            hi = self.int.hi << ((1 << w) - 1)
            out = Int(cases, self.int.lo << ((1 << w) - 1), hi)
            return self.like(Int(out.as_(out.narrow), out.lo, out.hi), self.width + (1 << w), self.signed)
        return self.like(I.shift_left(self.int, n, self.signed), None if self.width is None else self.width + n, self.signed)

    def __rshift__(self, n: int | Wave) -> Wave:
        if isinstance(n, Wave):
            value, w = self._operand(n)
            if w != self.width:
                raise ValueError("widths differ")
            a = self.int.pattern()
            moved = F.call_function("shiftright" if self.signed else "shiftrightunsigned", a, F.least(value.col, F.lit(63)).cast("int"))
            return self.like(Int(F.when(value.col > 63, F.lit(0)).otherwise(moved), self.int.lo, self.int.hi), self.width, self.signed)
        return self.like(I.shift_right(self.int, n), None if self.width is None else max(self.width - n, 0), self.signed)

    def __eq__(self, other: Any):  # type: ignore[override]
        return self._compare(other, True)

    def __ne__(self, other: Any):  # type: ignore[override]
        return self._compare(other, False)

    def _compare(self, other: Any, equal: bool):
        if not isinstance(other, (Wave, int, float)):
            return NotImplemented
        value, _ = self._operand(other)
        right = value.col if isinstance(value, Int) else value
        test = self.column == right if equal else self.column != right
        return self.like(Int(test.cast("bigint"), 0, 1), 1, False)

    def _order(self, other: Any, name: str) -> Wave:
        value, _ = self._operand(other)
        return self.like(Int(getattr(self.column, name)(value.col if isinstance(value, Int) else value).cast("bigint"), 0, 1), 1, False)

    def __lt__(self, other: Any) -> Wave:
        return self._order(other, "__lt__")

    def __le__(self, other: Any) -> Wave:
        return self._order(other, "__le__")

    def __gt__(self, other: Any) -> Wave:
        return self._order(other, "__gt__")

    def __ge__(self, other: Any) -> Wave:
        return self._order(other, "__ge__")

    def __getitem__(self, key: int | slice) -> Wave:
        """One bit, or bits ``high:low``, both included."""
        if isinstance(key, slice):
            if key.step is not None or key.start is None or key.stop is None or key.start < key.stop:
                raise ValueError("a bit range is [high:low] without a step")
            high, low = key.start, key.stop
        else:
            high = low = key
        if self.signed or self.int.lo < 0:
            base = I.low_bits(self.int, self.width or 64)
        else:
            base = self.int
        return self.like(I.low_bits(I.shift_right(base, low), high - low + 1), high - low + 1, False)

    def as_signed(self) -> Wave:
        """Two's complement of the width."""
        if self.signed:
            return self.copy()
        w = self.width
        value = I.low_bits(self.int, w)
        half = I.number(1 << (w - 1))
        out = F.when(value.as_(False) >= half, value.as_(False) - I.number(1 << w)).otherwise(value.as_(False))
        return self.like(Int(out.cast("bigint"), -(1 << (w - 1)), (1 << (w - 1)) - 1), w, True)

    def as_unsigned(self) -> Wave:
        if not self.signed:
            return self.copy()
        return self.like(I.low_bits(self.int, self.width), self.width, False)

    def bit_count(self) -> Wave:
        if self.width is None:
            raise ValueError("bit_count needs a width")
        low, high = (self, None) if self.width <= 64 else (self[63:0], self[self.width - 1 : 64])
        count = F.bit_count(low.int.pattern()).cast("bigint")
        if high is not None:
            count = count + F.bit_count(high.int.pattern()).cast("bigint")
        return self.like(Int(count, 0, self.width), 64, False)

    def split_bits(self, widths: int | Sequence[int], padding: bool = False) -> list[Wave]:
        """Groups of bits, the lowest first; ``padding`` allows a last group of fewer bits."""
        if isinstance(widths, int):
            full, rest = divmod(self.width, widths)
            if rest and not padding:
                raise ValueError("the width isn't a multiple of the group's")
            widths = [widths] * full + [rest] * bool(rest)
        elif sum(widths) != self.width:
            raise ValueError("group widths don't add up to the width")
        ends = list(itertools.accumulate(widths))
        return [self[e - 1 : e - w] for e, w in zip(ends, widths, strict=True)]

    @staticmethod
    def concatenate(waves: Sequence[Wave]) -> Wave:
        """All bits together, the first wave lowest."""
        if not waves:
            raise ValueError("nothing to concatenate")
        if any(w.signed or w.width is None for w in waves):
            raise ValueError("concatenation takes unsigned waves of known width")
        total, offset = None, 0
        for w in waves:
            part = I.shift_left(I.low_bits(w.int, w.width), offset, False)
            if total is None:
                total = part
            else:
                lo, hi = 0, (1 << (offset + w.width)) - 1
                narrow = I.fits(lo, hi)
                total = Int(total.as_(narrow) + part.as_(narrow), lo, hi)
            offset += w.width
        return waves[0].like(total, offset, False)

    # -- functions of values ---------------------------------------------------------------------------------------
    def map(self, func: Callable[[Any], Any], width: int | None = None, signed: bool = False) -> Wave:
        """A scalar Python function, in Arrow batches. Prefer ``map_column``."""
        kind = "double" if width is None else "bigint"
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(func)

        return self._wrap(run(self.column.cast("bigint") if self.int is not None and self.int.narrow else self.column), width, signed)

    def map_column(self, func: Callable[[Column], Column], width: int | None = None, signed: bool = False) -> Wave:
        return self._wrap(func(self.column), width, signed)

    def vectorized_map(self, func: Callable[[np.ndarray], np.ndarray], width: int | None = None, signed: bool = False) -> Wave:
        """A NumPy function of a batch of values; it must not look across samples."""
        @F.pandas_udf("double" if width is None else "bigint")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(func(s.to_numpy()))

        return self._wrap(run(self.column), width, signed)

    @staticmethod
    def merge(waves: Sequence[Wave], func: Callable[..., Any], width: int | None = None, signed: bool = False) -> Wave:
        """A Python function of the values of several waves of one frame."""
        @F.pandas_udf("double" if width is None else "bigint")
        def run(*s: pd.Series) -> pd.Series:
            return pd.Series([func(*x) for x in zip(*s, strict=True)])

        return waves[0]._wrap(run(*[w.column for w in waves]), width, signed)

    def _wrap(self, column: Column, width: int | None, signed: bool) -> Wave:
        if width is None:
            return self.like(column, None, signed)
        bounds = (-(1 << 63), (1 << 63) - 1) if signed else (0, (1 << min(width, 63)) - 1)
        return self.like(Int(column.cast("bigint"), *bounds), width, signed)

    # -- selection (see operators.select) and windows (see operators.windows) -----------------------------------------
    def one_bit(self) -> Column:
        if self.width != 1:
            raise TypeError("a one-bit wave is needed")
        return self.column != 0
