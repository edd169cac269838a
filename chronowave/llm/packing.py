"""Best-fit packing by large-item matching over a length histogram.

Documents become pieces of at most ``capacity`` tokens. Pieces above one third of the capacity are matched greedily, at
most two to a bin: the longest takes the longest that still fits. Shorter pieces then best-fit the gaps, longest first.
Equal lengths are interchangeable, so the plan works on counts per length: at most ``capacity`` counts, whatever the
corpus. A piece finds its place by its rank among the pieces of its length, counted in buckets and not in one task.

Defined results: a null or empty text is its closing id 0 alone; equal lengths are placed by (bucket, document, piece);
repeated rows are packed each; an empty table packs to nothing.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import fast_ids, open_fast, vocabulary_path
from .common import table, written

CAPACITY = 2048


class Slot(NamedTuple):
    """Pieces of ``length`` with ranks from ``first`` on, ``count`` of them, go to bins from ``bin`` on, all at ``offset``."""

    length: int
    first: int
    count: int
    bin: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int]:
    """The slots of all pieces and the number of bins. Bins of equal content are one range, so work follows the number of
    lengths and not the number of pieces."""
    slots: list[Slot] = []
    used: dict[int, int] = defaultdict(int)
    left = {n: c for n, c in counts.items() if c > 0}
    assert all(0 < n <= capacity for n in left), "pieces fit a bin"
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> ranges (first bin, bins)
    bins = 0

    def place(length: int, count: int, first_bin: int, offset: int) -> None:
        slots.append(Slot(length, used[length], count, first_bin, offset))
        used[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        fits = bisect.bisect_right(large, capacity - a)
        b = large[fits - 1] if fits else 0
        if b == a:
            m = left[a] // 2
        elif b:
            m = min(left[a], left[b])
        else:
            m = left[a]
        if not m:  # one piece is left of a length that pairs with itself
            below = bisect.bisect_left(large, a)
            b = large[below - 1] if below else 0
            m = 1
        place(a, m, bins, 0)
        if b:
            place(b, m, bins, a)
        gaps[capacity - a - b].append((bins, m))
        bins += m
        large = [n for n in large if left[n]]
    sizes = sorted(g for g in gaps if g)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(sizes, n)
            if at == len(sizes):
                gap, first, m = capacity, bins, -(-left[n] // (capacity // n))
                bins += m
            else:
                gap = sizes[at]
                first, m = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            fit = gap // n
            full = min(m, left[n] // fit)
            parts = [(first, full, fit)] if full else []
            if full < m and left[n] - full * fit:
                parts.append((first + full, 1, left[n] - full * fit))
            elif not full:
                parts.append((first, 1, left[n]))
            taken = 0
            for start, k, items in parts:
                for i in range(items):
                    place(n, k, start, capacity - gap + i * n)
                rest = gap - items * n
                if rest:
                    if not gaps[rest]:
                        bisect.insort(sizes, rest)
                    gaps[rest].append((start, k))
                taken += k
            if taken < m:
                if not gaps[gap]:
                    bisect.insort(sizes, gap)
                gaps[gap].append((first + taken, m - taken))
    return slots, bins


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with the separator at the end."""

    def run(batches):
        import pyarrow as pa

        bpe, end = open_fast(path), separator.to_bytes(4, "little")
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for key, text in zip(keys, texts, strict=True):
                packed = fast_ids(bpe, text).tobytes() + end
                n = len(packed) // 4
                at, size, piece = 0, n % capacity or capacity, 0
                while at < n:
                    rows.append((key, piece, at, size, zlib.crc32(packed[4 * at : 4 * (at + size)])))
                    at, size, piece = at + size, capacity, piece + 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (see ``pieces``) with ``sequence_id`` and ``offset``.

    Ranks: rows of one length are spread over buckets by a hash of the document; a bucket's rows are ranked by themselves
    and moved by the counts of the buckets before it, so a length that a third of all rows have is nobody's single task.
    """
    spark = found.sparkSession
    found = written(found, "pieces")
    n_buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int"))
    cells = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells, "cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots, _ = plan(counts, capacity)
    before = cells.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rn", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    rows = [(s.length, s.first, s.first + s.count, s.bin, s.offset) for s in slots]
    plan_df = spark.createDataFrame(rows, "length long, first long, until long, bin long, offset long")
    starts = plan_df.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "until", "bin", "offset"))).alias("slots"))
    rank = F.col("rn") + F.col("before")
    placed = ranked.join(before, ["length", "bucket"]).withColumn("rank", rank).join(F.broadcast(starts), "length")  # at most ``capacity`` rows
    slot = F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["until"]))[0]
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", slot.alias("s"), "rank").select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("s.bin") + F.col("rank") - F.col("s.first")).alias("sequence_id"), F.col("s.offset").alias("offset")
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path()))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: total size, and pieces above half that share no bin."""
    return max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
