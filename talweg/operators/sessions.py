"""Sessions and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 40
TTL_SECONDS = 24 * 3600
MESSAGE_CAP = 100


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def last_turns(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """(session_id, turn_id, ...) -> the last n turns of each session."""
    order = Window.partitionBy("session_id").orderBy(F.col("turn_id").desc())
    return turns.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def turns_per_session(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.count("*").alias("turns"))


def session_count(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count_distinct("session_id").alias("sessions"))


def session_activity(events: DataFrame) -> DataFrame:
    """(session_id, ts) -> (session_id, created_at, seen_at, messages), times in seconds."""
    t = seconds(F.col("ts"))
    return events.groupBy("session_id").agg(F.min(t).alias("created_at"), F.max(t).alias("seen_at"), F.count("*").alias("messages"))


def gate(asked: DataFrame, sessions: DataFrame, now: Column, ttl: int = TTL_SECONDS, cap: int = MESSAGE_CAP) -> DataFrame:
    """Which requests (session_id) may pass: missing, expired, capped or ok, in that order."""
    met = asked.join(sessions, "session_id", "left")
    status = F.when(F.col("seen_at").isNull(), "missing").when(now - F.col("seen_at") > ttl, "expired").when(F.col("messages") >= cap, "capped").otherwise("ok")
    return met.select("session_id", status.alias("status"))


def expired(sessions: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    return sessions.filter(now - F.col("seen_at") > ttl)


def without_sessions(turns: DataFrame, gone: DataFrame) -> DataFrame:
    """History without that of the sessions that are gone."""
    return turns.join(gone.select("session_id"), "session_id", "left_anti")


def split_by_inactivity(events: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """(user_id, event_id, ts) -> (user_id, session_no, started, ended, events): a gap above ttl ends a session."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(order) > ttl
    numbered = events.withColumn("session_no", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order))
    return numbered.groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def within_cap(events: DataFrame, cap: int = MESSAGE_CAP) -> DataFrame:
    """The first cap events of each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap)


def sliding_counts(events: DataFrame, window_seconds: int) -> DataFrame:
    """Events of the same user in the window that ends with each event, both ends included."""
    frame = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-window_seconds * 1_000_000, 0)
    return events.select("event_id", "user_id", F.count("*").over(frame).alias("n"))
