"""Sampling value changes on clock edges: the as-of join as one window over changes and edges together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clock_edges(changes: DataFrame, posedge: bool = False) -> DataFrame:
    """trace, clock, time of every clock change to 1 (or to 0), numbered from the trace's beginning.

    ``changes``: trace, time, seq, value (0/1).
    """
    edges = changes.where(F.col("value") == (1 if posedge else 0))
    number = F.row_number().over(W.partitionBy("trace").orderBy("time", "seq")).cast("bigint") - 1
    return edges.select("trace", number.alias("clock"), "time")


def window_edges(edges: DataFrame, begin_time: int | None = None, end_time: int | None = None, begin_cycle: int | None = None, end_cycle: int | None = None) -> DataFrame:
    """Edges inside a window of times or of cycles, the end excluded; cycles keep their absolute numbers."""
    if (begin_time is not None and begin_cycle is not None) or (end_time is not None and end_cycle is not None):
        raise ValueError("a bound is a time or a cycle, not both")
    for name, low, high in (("time", begin_time, end_time), ("clock", begin_cycle, end_cycle)):
        if low is not None:
            edges = edges.where(F.col(name) >= low)
        if high is not None:
            edges = edges.where(F.col(name) < high)
    return edges


def sample(edges: DataFrame, changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The last value at or before each edge; before the first change, the first value.

    ``edges``: trace, clock, time. ``changes``: trace, [by...], time, seq, value. With ``by`` (such as a signal's name) every
    edge is sampled for every combination of the trace. Traces without changes give no rows.
    """
    by = by or []
    part = W.partitionBy("trace", *by)
    wanted = edges
    if by:
        wanted = edges.join(changes.select("trace", *by).distinct(), "trace")
    else:
        wanted = edges.join(changes.select("trace").distinct(), "trace", "left_semi")
    kind = changes.schema["value"].dataType
    left = changes.select("trace", *by, "time", F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("is_edge"), F.lit(None).cast("bigint").alias("clock"), "value")
    right = wanted.select("trace", *by, "time", F.lit(0).cast("bigint").alias("seq"), F.lit(1).alias("is_edge"), "clock", F.lit(None).cast(kind).alias("value"))
    order = part.orderBy("time", "is_edge", "seq", "clock")
    held = F.last("value", True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    first = F.first("value", True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    both = left.unionByName(right).withColumn("sampled", F.coalesce(held, first)).where("is_edge = 1")
    number = F.row_number().over(part.orderBy("clock")).cast("bigint") - 1
    return both.select("trace", *by, number.alias("idx"), "clock", "time", F.col("sampled").alias("value"))


def unknown_bits(bits: Column, include_x: bool = True, include_z: bool = True) -> Column:
    """A 0/1 string that marks the x and z of a four-state string."""
    mark = lambda on: "1" if on else "0"
    return F.translate(F.lower(bits), "01xz", "00" + mark(include_x) + mark(include_z))


def known_bits(bits: Column, xz_value: int = 0) -> Column:
    """A 0/1 string with x and z replaced; other letters count as 0."""
    clean = F.translate(F.lower(bits), "xz", str(xz_value) * 2)
    return F.regexp_replace(clean, "[^01]", "0")


def extend_bits(bits: Column, width: int) -> Column:
    """Padded on the left: with x or z where the first letter is one, else with 0."""
    lead = F.lower(F.substring(bits, 1, 1))
    fill = F.when(lead.isin("x", "z"), lead).otherwise(F.lit("0"))
    padded = F.concat(F.repeat(fill, F.greatest(F.lit(width) - F.length(bits), F.lit(0))), F.lower(bits))
    return F.when(F.length(bits) > width, F.raise_error(F.lit("a value is wider than its signal"))).otherwise(padded)


def bits_value(bits: Column, width: int) -> Column:
    """The unsigned number of a 0/1 string: BIGINT up to 63 bits, DECIMAL(38, 0) up to 126."""
    if width <= 63:
        return F.conv(bits, 2, 10).cast("bigint")
    if width > 126:
        raise NotImplementedError("values past 126 bits")
    low = F.conv(F.substring(bits, -63, 63), 2, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(bits, 1, width - 63), 2, 10).cast("decimal(38,0)")
    return (high * F.expr(f"CAST('{1 << 63}' AS decimal(38,0))").cast("decimal(19,0)")).cast("decimal(38,0)") + low
