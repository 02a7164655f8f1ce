"""Retrieval for many questions at once: candidates, fusion, cut, final order. One plan per mode."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.text import tokens
from talweg.functions.vectors import bucket, hashed
from talweg.operators import fusion
from talweg.operators.dense import best_rows
from talweg.operators.lexical import bm25, ranked

CANDIDATES, TOP = 20, 4
DIMENSIONS = 64


def dense_topk(queries: DataFrame, docs: DataFrame, top: int, dimensions: int = DIMENSIONS) -> DataFrame:
    """(query_id, text), (doc_id, text) -> (query_id, doc_id, score, rank): cosine of the offline embeddings.

    The questions are the caller's and become a matrix on the driver. Each batch of documents is one matrix
    product; a task keeps its best rows, so what is shuffled grows with the tasks and the questions only. Pairs
    without a common bucket have no score. Ids of documents are whole numbers or strings.
    """
    asked: dict[int, np.ndarray] = {}
    for r in hashed(queries, "query_id", dimensions).collect():
        asked.setdefault(r.query_id, np.zeros(dimensions))[r.bucket] = r.value
    ids = sorted(asked)
    matrix = np.array([asked[i] for i in ids]).reshape(len(ids), dimensions)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for batch in batches:
            if batch.num_rows and ids:
                lists = batch.column(1)
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                counts = np.bincount(of * dimensions + lists.flatten().to_numpy(zero_copy_only=False), minlength=len(lists) * dimensions).reshape(-1, dimensions)
                yield batch.column(0), np.round(counts @ matrix.T / np.maximum(np.sqrt((counts * counts).sum(axis=1)), 1e-30)[:, None], 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from best_rows(scored(batches), ids, top, above=0.0)

    key = docs.schema["doc_id"].dataType
    placed = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.transform(tokens(F.col("text")), lambda t: bucket(t, dimensions)).alias("b"))
    found = placed.mapInArrow(run, f"query_id bigint, doc_id {key.simpleString()}, score double")
    return ranked(found, top).withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))


def cosines(pairs: DataFrame, queries: DataFrame, docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(query_id, doc_id, ...) with score: the cosine of each pair; only the documents among the pairs are embedded."""
    wanted = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = hashed(queries, "query_id", dimensions).withColumnRenamed("value", "q")
    met = pairs.select("query_id", "doc_id").join(hashed(wanted, "doc_id", dimensions), "doc_id").join(asked, ["query_id", "bucket"])
    sums = met.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("value") * F.col("q")), 6).alias("score"))
    return pairs.join(sums, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def retrieve(queries: DataFrame, docs: DataFrame, mode: str = "hybrid", *, top: int | None = TOP, candidates: int = CANDIDATES, threshold: float | None = None) -> DataFrame:
    """(query_id, text), (doc_id, text) -> (query_id, doc_id, rank, score).

    hybrid: both rankings fused, the cut made on cosines of all fused candidates, the order that of the fusion.
    dense: cosines, cut. lexical: BM25 order, no score and no cut. The cut is adaptive unless a threshold is given.
    """
    candidates = max(candidates, top or 0)
    if mode == "lexical":
        rows = bm25(queries, docs, candidates).select("query_id", "doc_id", "rank", F.lit(None).cast("double").alias("score"))
    else:
        dense = dense_topk(queries, docs, candidates)
        if mode == "dense":
            rows = dense.select("query_id", "doc_id", "rank", "score")
        else:
            both = bm25(queries, docs, candidates).select("query_id", "doc_id", "rank").unionByName(dense.select("query_id", "doc_id", "rank"))
            rows = cosines(ranked(fusion.fuse(both), candidates).select("query_id", "doc_id", "rank"), queries, docs)
        rows = fusion.cut_adaptive(rows) if threshold is None else fusion.cut_fixed(rows, threshold)
    if top is None:
        return rows
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
    return rows.withColumn("rank", final).filter(F.col("rank") <= top)


def retrieve_chunks(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", **limits) -> DataFrame:
    """retrieve() over chunks (doc, chunk_no, text, ...): (query_id, rank, score) with all columns of the chunks found."""
    named = chunks.withColumn("doc_id", F.concat(F.col("doc"), F.lit("#"), F.lpad(F.col("chunk_no").cast("string"), 10, "0")))
    found = retrieve(queries, named.select("doc_id", "text"), mode, **limits)
    return named.join(found, "doc_id").select("query_id", "rank", "score", *chunks.columns)
