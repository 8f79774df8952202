"""Windowed aggregates of an event stream, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """window_start, event_type, n, value_sum; works on batch and streaming frames alike."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "value_sum")


def start(events: DataFrame, sink, checkpoint: str, window: str = "1 day", late: str = "1 day"):
    """Runs ``sink(batch, id)`` on each finished set of windows."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(events, window, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
