"""Structured Streaming: event-time windows over a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(samples: DataFrame, window: str, slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Per trace and event-time window: samples, mean, least and greatest value. ``samples``: trace, ts, value; streaming or
    not. Samples later than the watermark are left out, as Spark does."""
    return (
        samples.withWatermark("ts", watermark)
        .groupBy("trace", F.window("ts", window, slide or window).alias("window"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    )
