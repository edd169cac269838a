"""Integer columns with known bounds.

A value is a BIGINT column where its interval fits 63 bits, else a DECIMAL(38, 0). Unsigned arithmetic wraps at 2^64 and
signed arithmetic at int64, never at a signal's width, which is only a label. Division and remainder are floored, and by
zero give zero. Everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

I63, U64 = 1 << 63, 1 << 64
DECIMAL = "decimal(38,0)"


def number(n: int) -> Column:
    return F.lit(n) if -I63 <= n < I63 else F.expr(f"CAST('{n}' AS {DECIMAL})")


def fits(lo: int, hi: int) -> bool:
    return -I63 <= lo and hi < I63


@dataclass(frozen=True)
class Int:
    """A column and an interval that holds all its values."""

    col: Column
    lo: int
    hi: int

    @staticmethod
    def of(n: int) -> Int:
        return Int(number(n), n, n)

    @property
    def narrow(self) -> bool:
        return fits(self.lo, self.hi)

    def as_(self, narrow: bool) -> Column:
        return self.col.cast("bigint" if narrow else DECIMAL)

    def settle(self, signed: bool) -> Int:
        """Wrapped into 64 bits where it can leave them, and narrow where it can be."""
        lo, hi, col = self.lo, self.hi, self.col
        if signed and not fits(lo, hi):
            col, lo, hi = F.pmod(col + number(I63), number(U64)) - number(I63), -I63, I63 - 1
        elif not signed and (lo < 0 or hi >= U64):
            col, lo, hi = F.pmod(col, number(U64)), 0, U64 - 1
        return Int(col.cast("bigint" if fits(lo, hi) else DECIMAL), lo, hi)

    def pattern(self) -> Column:
        """The 64-bit pattern as BIGINT."""
        return self.col.cast("bigint") if self.narrow else F.when(self.col >= number(I63), self.col - number(U64)).otherwise(self.col).cast("bigint")

    @staticmethod
    def unsigned(pattern: Column, width: int) -> Int:
        """The unsigned value of a BIGINT pattern of ``width`` bits."""
        if width < 64:
            return Int(pattern, 0, (1 << max(width, 0)) - 1)
        return Int(F.when(pattern < 0, pattern.cast(DECIMAL) + number(U64)).otherwise(pattern.cast(DECIMAL)), 0, U64 - 1)


def add(a: Int, b: Int, signed: bool, sign: int = 1) -> Int:
    lo, hi = (a.lo + b.lo, a.hi + b.hi) if sign > 0 else (a.lo - b.hi, a.hi - b.lo)
    narrow = fits(lo, hi) and a.narrow and b.narrow
    x, y = a.as_(narrow), b.as_(narrow)
    return Int(x + y if sign > 0 else x - y, lo, hi).settle(signed)


def multiply(a: Int, b: Int, signed: bool) -> Int:
    ends = [x * y for x in (a.lo, a.hi) for y in (b.lo, b.hi)]
    lo, hi = min(ends), max(ends)
    if max(abs(lo), abs(hi)) < 10**37:
        narrow = fits(lo, hi) and a.narrow and b.narrow
        return Int(a.as_(narrow) * b.as_(narrow), lo, hi).settle(signed)
    # 64 x 64 bits pass 38 digits: 32-bit halves of the patterns, whose products have 20 digits.
    half = lambda p, high: (F.shiftrightunsigned(p, 32) if high else p.bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(10,0)")
    x, y = a.pattern(), b.pattern()
    limb = F.expr(f"CAST({1 << 32} AS decimal(10,0))")
    middle = F.pmod(half(x, False) * half(y, True) + half(x, True) * half(y, False), limb).cast("decimal(10,0)")
    return Int((middle * limb + half(x, False) * half(y, False)).cast(DECIMAL), 0, 1 << 65).settle(signed)


def divide(a: Int, b: Int, signed: bool) -> tuple[Int, Int]:
    """Floored quotient and remainder; zero by zero."""
    narrow = a.narrow and b.narrow
    x, y = a.as_(narrow), b.as_(narrow)
    zero = y == number(0)
    safe = F.when(zero, number(1)).otherwise(y).cast("bigint" if narrow else DECIMAL)
    rem = x % safe
    off = (rem != number(0)) & ((rem < number(0)) != (safe < number(0)))
    floor_rem = F.when(zero, number(0)).when(off, rem + safe).otherwise(rem)
    whole = F.call_function("div", x, safe) if narrow else ((x - rem) / safe).cast(DECIMAL)
    quotient = F.when(zero, number(0)).when(off, whole - 1).otherwise(whole)
    big = max(abs(a.lo), abs(a.hi))
    span = max(abs(b.lo), abs(b.hi))
    return (
        Int(quotient, -big - 1 if signed else 0, big).settle(signed),
        Int(floor_rem, -span if signed else 0, span).settle(signed),
    )


def power(a: Int, n: int, signed: bool) -> Int:
    """By repeated squaring, wrapped after each product."""
    out, base = Int.of(1), a
    while n:
        if n & 1:
            out = multiply(out, base, signed)
        n >>= 1
        if n:
            base = multiply(base, base, signed)
    return out


def shift_left(a: Int, n: int, signed: bool) -> Int:
    """Without wrapping, up to 126 bits."""
    lo, hi = a.lo << n, a.hi << n
    if hi >= 10**38 or lo <= -(10**38):
        raise NotImplementedError("values past 126 bits")
    return Int(F.shiftleft(a.col, n) if fits(lo, hi) and a.narrow and n < 63 else a.as_(False) * number(1 << n), lo, hi)


def shift_right(a: Int, n: int) -> Int:
    if n >= 126:
        return Int(F.when(a.col < number(0), number(-1)).otherwise(number(0)).cast("bigint"), -1 if a.lo < 0 else 0, 0)
    lo, hi = a.lo >> n, a.hi >> n
    if a.narrow:
        return Int(F.shiftright(a.col, min(n, 63)), lo, hi)
    col = F.floor(a.as_(False) / number(1 << n)) if n else a.col
    if n:  # division of decimals rounds at the scale's end: subtract the remainder first
        rest = F.pmod(a.as_(False), number(1 << n))
        col = ((a.as_(False) - rest) / number(1 << n)).cast(DECIMAL)
    return Int(col.cast("bigint" if fits(lo, hi) else DECIMAL), lo, hi)


def low_bits(a: Int, width: int) -> Int:
    """The unsigned value of the lowest bits."""
    hi = (1 << width) - 1
    if a.narrow and width < 63:
        return Int(a.col.bitwiseAND(F.lit(hi)), 0, hi)
    return Int(F.pmod(a.as_(False), number(1 << width)).cast("bigint" if fits(0, hi) else DECIMAL), 0, hi)
