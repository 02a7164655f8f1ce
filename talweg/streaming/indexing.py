"""Index maintenance driven by a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talweg.operators.indexing import Index


def maintain(documents: DataFrame, index: Index, checkpoint: str, whole: bool = False) -> StreamingQuery:
    """A stream of (doc, text[, at]) keeps an index up to date; a repeated batch changes nothing.

    Documents of a micro-batch replace those of the same name, of several the one with the latest ``at``; others stay.
    With ``whole`` each micro-batch is the full current state, and documents that it lacks go.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        if "at" in batch.columns:
            latest = Window.partitionBy("doc").orderBy(F.col("at").desc(), F.xxhash64("text"))
            batch = batch.withColumn("__n", F.row_number().over(latest)).filter("__n = 1")
        batch = batch.select("doc", "text")
        (index.build if whole else index.update)(batch)

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
