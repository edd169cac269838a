"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space and U+0009..U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is the only binding that Catalyst never inlines, so an array used inside another lambda is not
    computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR_CLASS + "+"), lambda w: w != "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the costly column ``value``, computed once per row.

    A generator of one element keeps later filters above it; pushed through a projection, they would compute it again.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed by position, and the new name of each: an operator's own names then clash with none."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def shown(names: dict[str, str], *without: str) -> list[Column]:
    """The columns of ``hidden`` under their old names, but for those named (in any case) in ``without``."""
    return [F.col(h).alias(c) for c, h in names.items() if c.lower() not in without]


def text_groups(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of a batch with about so many characters each: bounds memory, whatever the texts' lengths."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


#: Rows in an Arrow batch at most: a Python worker then holds few long texts at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a new one on a local master
    (tests); elsewhere an error, as executors would write where nobody else reads."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = getattr(shared_dir, "own", "") or "file://" + tempfile.mkdtemp(prefix="chronowave-")
        shared_dir.own = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table or archive in the shared folder."""
    return f"{shared_dir(spark)}/chronowave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def drop_tables(*tables: DataFrame) -> None:
    """Remove written tables that no later plan reads."""
    for t in tables:
        drop_path(t.sparkSession, t.scratch_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a membership table: 4 MB, whatever the input.
BITS = 1 << 25


def bit_table(values: DataFrame, column: str):
    """A broadcast bit table of the long ``column``: a fixed size, so it may hit falsely but never misses."""
    import numpy as np

    low = F.col(column).bitwiseAND(F.lit(BITS - 1))
    cells = values.select(low.alias("at")).selectExpr("CAST(at >> 6 AS INT) AS w", "shiftleft(1L, CAST(at & 63 AS INT)) AS b")
    found = cells.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most BITS / 64 rows of 12 bytes
    out = np.zeros(BITS // 64, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return values.sparkSession.sparkContext.broadcast(out.tobytes())


def in_table(bits: bytes, values):
    """Which of the numpy longs may be in a bit table."""
    import numpy as np

    words = np.frombuffer(bits, np.int64)
    at = values & np.int64(BITS - 1)
    return ((words[at >> 6] >> (at & 63)) & 1).astype(bool)

