"""Activity counts over a stream, beyond the batch engine: tumbling windows with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = (), width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and keys; works on batch and streaming frames alike. ts is a timestamp with zone."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")
