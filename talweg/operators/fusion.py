"""Rank fusion, relevance cuts and reranking."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

RRF_K = 60
MARGIN, FLOOR = 0.85, 0.30


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, source, rank, doc_id) -> (query_id, doc_id, score): the sum of 1 / (k + rank) over all lists."""
    return rankings.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def cut_adaptive(scored: DataFrame, score: str = "score", margin: float = MARGIN, floor: float = FLOOR) -> DataFrame:
    """Rows at or above both the floor and a part of their query's best score; without any score, every row."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    marked = scored.withColumn("__best", best)
    return marked.filter(F.col("__best").isNull() | (F.col(score) >= F.greatest(F.lit(floor), margin * F.col("__best")))).drop("__best")


def cut_fixed(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Rows at or above the threshold; for a query without any score, every row."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    return scored.withColumn("__best", best).filter(F.col("__best").isNull() | (F.col(score) >= threshold)).drop("__best")


def merge_rerank(candidates: DataFrame, reranked: DataFrame, top: int) -> DataFrame:
    """Candidates (query_id, doc_id, rank) in the order (query_id, position, doc_id, score_rerank) that a scorer gave.

    Unknown ids are dropped and of repeated ones the first counts. A query with at most ``top`` candidates, or
    whose answer has no valid id, keeps its order.
    """
    size = F.count("*").over(Window.partitionBy("query_id"))
    first = Window.partitionBy("query_id", "doc_id").orderBy("position")
    order = reranked.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    met = candidates.withColumn("__size", size).join(order, ["query_id", "doc_id"], "left")
    used = (F.col("__size") > top) & F.max(F.col("position").isNotNull()).over(Window.partitionBy("query_id"))
    met = met.withColumn("__used", used).filter(~F.col("__used") | F.col("position").isNotNull())
    place = F.when(F.col("__used"), F.col("position")).otherwise(F.col("rank"))
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(place, "doc_id"))
    score = F.when(F.col("__used"), F.col("score_rerank"))
    return met.select("query_id", "doc_id", "rank", score.alias("score_rerank"), final.alias("final_rank")).filter(F.col("final_rank") <= top)


# reranking

#: A scorer: a question and texts in, (number of the text, score) out, the best first.
Scorer = Callable[[str, list[str]], list[tuple[int, float]]]
#: Scorers by name; open to further ones. None is built in: a scorer is a remote model.
SCORERS: dict[str, Scorer] = {}
SCORER_SECONDS = 20.0


def parsed_ranking(answer: str) -> list[tuple[int, float]]:
    """A model's answer that contains a JSON array of numbers, or of objects with id and score, as a ranking; else ValueError."""
    found = re.search(r"\[.*\]", re.sub(r"(?m)^```(json)?|```$", "", answer or ""), re.S)
    if not found:
        raise ValueError("no array in the answer")
    order = []
    for place, item in enumerate(json.loads(found[0])):
        number, score = (item.get("id"), item.get("score")) if isinstance(item, dict) else (item, None)
        if isinstance(number, int) and not isinstance(number, bool):
            order.append((number, float(score) if isinstance(score, (int, float)) else -float(place)))
    return order


def asked(question: str, texts: list[str], scorers: Sequence[Scorer], seconds: float = SCORER_SECONDS) -> list[tuple[int, float]]:
    """The ranking of the first scorer that answers in time with a valid number; empty if none does."""
    for scorer in scorers:
        pool = ThreadPoolExecutor(1)
        try:
            order = [(i, s) for i, s in pool.submit(scorer, question, texts).result(timeout=seconds) if 0 <= i < len(texts)]
            if order:
                return order
        except Exception as error:  # the next one is asked, at last the order stays
            log.warning("a scorer failed: %s", error or type(error).__name__)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
    return []


def reranked(candidates: DataFrame, questions: DataFrame, backends: Sequence[str], top: int, seconds: float = SCORER_SECONDS) -> DataFrame:
    """candidates (query_id, doc_id, rank, text), questions (query_id, text) in the order of the first backend that answers.

    A question's candidates are few (its top n), and are scored together. Unknown backends are a ValueError.
    """
    unknown = [b for b in backends if b not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scorers: {unknown}")
    scorers = [SCORERS[b] for b in backends]
    key = candidates.schema["doc_id"].dataType.simpleString()
    query = candidates.schema["query_id"].dataType.simpleString()

    def score(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rank", "ascending"), ("doc_id", "ascending")])
        order = asked(group["question"][0].as_py() or "", [t or "" for t in group["text"].to_pylist()], scorers, seconds)
        ids, of = group["doc_id"].to_pylist(), group["query_id"][0].as_py()
        columns = {"query_id": pa.array([of] * len(order), group["query_id"].type), "position": pa.array(range(len(order)), pa.int32()), "doc_id": pa.array([ids[i] for i, _ in order], group["doc_id"].type)}
        return pa.table(columns | {"score_rerank": pa.array([float(s) for _, s in order], pa.float64())})

    met = candidates.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    scored = met.groupBy("query_id").applyInArrow(score, f"query_id {query}, position int, doc_id {key}, score_rerank double")
    return merge_rerank(candidates.select("query_id", "doc_id", "rank"), scored, top)
