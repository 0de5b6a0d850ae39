"""Streams: running peaks per key, fixed slots with late rows dropped, and idempotent emission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def peaks(stream: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Per key the greatest value so far, first and last time seen and the number of rows; for update or complete mode, or a batch."""
    return stream.groupBy(*keys).agg(F.max(value).alias("peak"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n"))


def slots(stream: DataFrame, time: str, keys: list[str], value: str, length: str = "5 minutes", start: str = "4 minutes", late: str = "1 hour") -> DataFrame:
    """Sums per fixed slot and key; rows later than ``late`` are dropped once the watermark has passed them."""
    held = stream.withWatermark(time, late) if stream.isStreaming else stream
    return held.groupBy(F.window(time, length, length, start).alias("slot"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("slot.start").alias("slot_start"), *keys, "n", "total")


def once(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once, also when it is sent again within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)
