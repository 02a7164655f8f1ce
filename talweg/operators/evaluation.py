"""Evaluation: relevance of what was retrieved, recall and reciprocal rank, judged metrics, parameter sweeps."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.text import normalize_eval
from talweg.operators import bulk, chunking
from talweg.operators.retrieval import TOP, retrieve_chunks

#: Fixed phrases by which an answer admits that it lacks the information.
REFUSALS = (
    "no tengo esa informacion",
    "no tengo informacion",
    "no dispongo",
    "no puedo ayudarte con eso",
    "no aparece",
    "no se menciona",
    "no encuentro",
    "no tengo datos",
)
#: The grid of a sweep. None is the adaptive cut.
MODES = ("dense", "lexical", "hybrid")
TOP_KS = (3, 4, 6, 8)
THRESHOLDS = (None, 0.3, 0.4, 0.5, 0.6)
CHUNK_SIZES, CHUNK_OVERLAPS = (600, 900, 1400), (100, 150)


def is_refusal(answer: Column) -> Column:
    plain = normalize_eval(answer)
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(plain, F.lit(phrase))
    return out


def is_relevant(text: Column, source: Column, page: Column, expected: Column, document: Column, expected_page: Column) -> Column:
    """All declared criteria hold: passage contained, same source, same page; without any criterion, no."""
    wanted = normalize_eval(expected)
    declared = (wanted != "") | (F.coalesce(document, F.lit("")) != "") | expected_page.isNotNull()
    inside = (wanted == "") | F.contains(normalize_eval(text), wanted)
    return declared & inside & ((F.coalesce(document, F.lit("")) == "") | (source == document)) & (expected_page.isNull() | (page == expected_page))


def first_hits(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """cases (query_id, ...), retrieved (query_id, rank, hit) -> cases with position: the rank of the first hit, or null."""
    found = retrieved.filter("hit").groupBy("query_id").agg(F.min("rank").alias("position"))
    return cases.join(found, "query_id", "left")


def _positive() -> Column:
    return F.coalesce("kind", F.lit("positive")) != "negative"


def recall_mrr(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(kind, position[, latency_ms]) -> (cases, positives, negatives, recall, mrr[, mean_latency_ms]); a missing kind counts as positive."""
    positive = _positive()
    latency = [F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms")] if "latency_ms" in results.columns else []
    return results.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if(positive).alias("positives"),
        F.count_if(~positive).alias("negatives"),
        F.round(F.avg(F.when(positive, F.col("position").isNotNull().cast("double"))), 6).alias("recall"),
        F.round(F.avg(F.when(positive, F.coalesce(1.0 / F.col("position"), F.lit(0.0)))), 6).alias("mrr"),
        *latency,
    )


def by_mrr(metrics: DataFrame, *order: str) -> DataFrame:
    """A sweep's rows, the best reciprocal rank first; without one they come last, and ties keep the order of the grid."""
    return metrics.orderBy(F.coalesce("mrr", F.lit(0.0)).desc(), *order)


def judge_metrics(results: DataFrame) -> DataFrame:
    """(kind, faithful, answers, grade, refuses) -> means that skip nulls: the first three over positives, the last over negatives."""
    positive = _positive()
    mean = lambda column, who: F.round(F.avg(F.when(who, F.col(column).cast("double"))), 6)
    return results.agg(F.count("*").alias("cases"), mean("faithful", positive).alias("faithfulness"), mean("answers", positive).alias("answered"), mean("grade", positive).alias("mean_grade"), mean("refuses", ~positive).alias("refusal_rate"))


def chunk_sizes() -> list[tuple[int, int]]:
    """The chunking parameters to try; an overlap is smaller than its size."""
    return [(size, overlap) for size in CHUNK_SIZES for overlap in CHUNK_OVERLAPS if overlap < size]


def chunk_sweep(cases: DataFrame, docs: DataFrame, mode: str = "lexical", top: int = TOP) -> DataFrame:
    """cases (query_id, text, expected[, kind]), docs (doc, text) -> (chunk_size, chunk_overlap, chunks, recall, mrr, latency_ms).

    For every pair of parameters the documents are chunked anew, the cases retrieved among these chunks, and what was found
    held against the expected passages. Latency is the time of one retrieval divided by its cases; lexical retrieval shares
    one pass over the documents among all pairs, and a pair's time is that of the tasks that scored its chunks.
    """
    n = cases.count()
    told = (cases if "kind" in cases.columns else cases.withColumn("kind", F.lit("positive"))).select("query_id", "kind")
    made = _lexical_runs(cases, told, docs, top, n) if mode == "lexical" else _runs(cases, told, docs, mode, top, n)
    return by_mrr(cases.sparkSession.createDataFrame(made, "chunk_size int, chunk_overlap int, chunks bigint, recall double, mrr double, latency_ms double"), "chunk_size", "chunk_overlap")


def _hit() -> Column:
    return is_relevant(F.col("found"), F.lit(None), F.lit(None), F.col("expected"), F.lit(None), F.lit(None).cast("int")).alias("hit")


def _lexical_runs(cases: DataFrame, told: DataFrame, docs: DataFrame, top: int, n: int) -> list[tuple]:
    grid = chunk_sizes()
    found, chunks, seconds = bulk.chunks_found(cases.select("query_id", "text"), docs, grid, top)
    met = found.join(cases.select("query_id", "expected"), "query_id").select("part", "query_id", "rank", _hit())
    firsts = met.filter("hit").groupBy("part", "query_id").agg(F.min("rank").alias("position"))
    parts = F.broadcast(cases.sparkSession.createDataFrame([(k,) for k in range(len(grid))], "part int"))  # the grid
    seen = {r.part: r for r in recall_mrr(told.crossJoin(parts).join(firsts, ["part", "query_id"], "left"), ("part",)).collect()}
    numbers = lambda k: (seen[k].recall, seen[k].mrr) if k in seen else (None, None)
    return [(*pair, chunks.get(k, 0), *numbers(k), 1000 * seconds.get(k, 0.0) / max(1, n)) for k, pair in enumerate(grid)]


def _runs(cases: DataFrame, told: DataFrame, docs: DataFrame, mode: str, top: int, n: int) -> list[tuple]:
    rows = []
    for size, overlap in chunk_sizes():
        chunks = chunking.chunks(docs, size, overlap)
        began = time.perf_counter()
        found = retrieve_chunks(cases.select("query_id", "text"), chunks, mode, top=top).select("query_id", "rank", F.col("text").alias("found"))
        hits = found.join(cases.select("query_id", "expected"), "query_id").select("query_id", "rank", _hit())
        seen = recall_mrr(first_hits(told, hits)).first()
        rows.append((size, overlap, chunks.count(), seen.recall, seen.mrr, 1000 * (time.perf_counter() - began) / max(1, n)))
    return rows
