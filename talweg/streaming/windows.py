"""Event-time windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.operators.sessions import TTL_SECONDS


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def counts(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events of each user in tumbling or sliding windows."""
    grouped = _timed(events, late).groupBy(F.window("ts", length, slide or length).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def sessions(events: DataFrame, ttl: int = TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """Sessions that end with a gap above ttl."""
    grouped = _timed(events, late).groupBy(F.session_window("ts", f"{ttl} seconds").alias("w"), "user_id").agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("until"), "events")
