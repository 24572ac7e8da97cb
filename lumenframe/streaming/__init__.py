"""Running versions of the histogram operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_histogram(events: DataFrame, minutes: int = 60, late: str = "2 hours", low: int = 0, high: int = 255) -> DataFrame:
    """(start, bin, n): clamped histogram of `value` for each window of event time; state is dropped once the watermark has passed a window."""
    bins = F.greatest(F.lit(low), F.least(F.lit(high), F.floor("value"))).cast("int").alias("bin")
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), bins).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "bin").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "bin", "n")
