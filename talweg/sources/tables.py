"""Typed readers and writers of the engine's own tables."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = "id string, tipo string, pregunta string, esperado string, documento string, pagina int, nota string"
TURN_SCHEMA = "session_id string, turn_id bigint, role string, text string, created_at timestamp"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array, as (query_id, kind, text, expected, document, page). Missing or empty: ValueError."""
    try:
        rows = spark.read.schema(CASE_SCHEMA).json(path, multiLine=True)
    except AnalysisException as error:
        raise ValueError(f"no evaluation cases at {path}") from error
    rows = rows.filter("id IS NOT NULL OR pregunta IS NOT NULL")
    if rows.isEmpty():
        raise ValueError(f"no evaluation cases in {path}")
    kind = F.when(F.col("tipo") == "negativo", "negative").otherwise("positive")
    return rows.select(F.col("id").alias("query_id"), kind.alias("kind"), F.col("pregunta").alias("text"), F.col("esperado").alias("expected"), F.col("documento").alias("document"), F.col("pagina").alias("page"))


class History:
    """Turns of many sessions in a folder that is only ever appended to: a reset hides what a session had before it."""

    SCHEMA = f"{TURN_SCHEMA}, reset boolean, stamp bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: DataFrame, stamp: int) -> None:
        rows.withColumn("stamp", F.lit(stamp).cast("bigint")).select("session_id", "turn_id", "role", "text", "created_at", "reset", "stamp").write.mode("append").parquet(self.path)

    def _resets(self, sessions: DataFrame) -> DataFrame:
        empty = {"turn_id": "bigint", "role": "string", "text": "string", "created_at": "timestamp"}
        return sessions.select("session_id").distinct().withColumns({k: F.lit(None).cast(t) for k, t in empty.items()} | {"reset": F.lit(True)})

    def append(self, turns: DataFrame) -> None:
        self._append(turns.withColumn("reset", F.lit(False)), time.time_ns())

    def replace(self, turns: DataFrame) -> None:
        """The sessions among the turns have these turns and no others. One write, so it happens whole or not at all."""
        self._append(self._resets(turns).unionByName(turns.select("session_id", "turn_id", "role", "text", "created_at").withColumn("reset", F.lit(False))), time.time_ns())

    def delete(self, sessions: DataFrame) -> None:
        self._append(self._resets(sessions), time.time_ns())

    def turns(self) -> DataFrame:
        """What every session has now. A missing folder is an empty history."""
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], TURN_SCHEMA)
        last = rows.filter("reset").groupBy("session_id").agg(F.max("stamp").alias("since"))
        met = rows.filter("NOT reset").join(last, "session_id", "left").filter("since IS NULL OR stamp >= since")
        return met.select("session_id", "turn_id", "role", "text", "created_at")

    def load(self, session_id: str) -> DataFrame:
        return self.turns().filter(F.col("session_id") == session_id).orderBy("turn_id")


def load_json_history(spark: SparkSession, path: str) -> DataFrame:
    """(turn_id, role, text) out of JSON lines; a missing or corrupt history is an empty one."""
    schema = "turn_id bigint, role string, text string"
    try:
        rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    bad = not rows.filter("_corrupt IS NOT NULL").isEmpty()
    rows.unpersist()
    return spark.createDataFrame([], schema) if bad else rows.drop("_corrupt").orderBy("turn_id")


def save_json_history(turns: DataFrame, path: str) -> None:
    """Overwrites the history of one session, which is bounded, with one JSON object a turn."""
    turns.select("turn_id", "role", "text").coalesce(1).write.mode("overwrite").json(path)


def append_run(metrics: DataFrame, config: dict, path: str) -> None:
    """One evaluation run as CSV rows, configuration beside metrics; every file of the folder has the header."""
    rows = metrics.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("run_at"), *[F.lit(str(v)).alias(k) for k, v in config.items()], "*")
    rows.coalesce(1).write.mode("append").csv(path, header=True)


def write_log(events: DataFrame, path: str) -> None:
    """One JSON object a line."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
