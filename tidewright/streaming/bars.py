"""Hourly candles from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly candles from a stream of (event_id, ts, event_type, value); an hour closes once ``late`` has passed."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
             F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
