"""Answering: pluggable models, retry, query rewriting, one conversational turn, embedding of whole columns."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.vectors import l2_normalized
from talweg.operators.context import ROLE_LABELS
from talweg.operators.sessions import HISTORY

#: A model: a prompt in, a text out. An embedder: texts in, vectors of one length out, in order.
Generate = Callable[[str], str]
Embed = Callable[[list[str]], list[list[float]]]

BATCH, TRIES, PAUSE = 10, 3, 5.0
REWRITE_PAIRS = 3


class Busy(Exception):
    """The provider asks to come back later."""


def with_retry(call: Callable, *args, tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep):
    """The call's result; when the provider is busy, wait longer each time, with jitter. Other errors pass through."""
    for attempt in range(1, tries + 1):
        try:
            return call(*args)
        except Busy:
            if attempt == tries:
                raise
            sleep(pause * attempt * random.uniform(0.8, 1.2))


def streamed(call: Callable[[], Iterator[str]], tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """The pieces of an answer as they come. A busy provider is asked again only while nothing was passed on."""
    for attempt in range(1, tries + 1):
        passed = False
        try:
            for piece in call():
                passed = True
                yield piece
            return
        except Busy:
            if passed or attempt == tries:
                raise
            sleep(pause * attempt * random.uniform(0.8, 1.2))


def embedded(texts: DataFrame, embed: Embed, key: str = "doc_id", batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE, task: str | None = None, workers: int | None = None) -> DataFrame:
    """(key, text) -> (key, embedding), unit vectors. Rows keep their key, so neither order nor parallelism matters.

    Each partition asks in batches; partitions are the parallelism, ``workers`` of them if that is given. A batch that stays
    busy fails its task, which Spark runs again. ``task`` says what the vectors are for, and is passed to the embedder.
    """
    ask = embed if task is None else partial(embed, task=task)
    texts = texts if workers is None else texts.repartition(workers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            asked = [t or "" for t in rows.column(1).to_pylist()]
            vectors: list[list[float]] = []
            for at in range(0, len(asked), batch):
                vectors += with_retry(ask, asked[at : at + batch], tries=tries, pause=pause)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, "embedding"])

    kind = texts.schema[key].dataType.simpleString()
    made = texts.select(key, "text").mapInArrow(run, f"{key} {kind}, embedding array<float>")
    return made.withColumn("embedding", l2_normalized(F.col("embedding")).cast("array<float>"))


def rewritten(question: str, history: list[tuple[str, str]], generate: Generate, prompt: str = "{conversation}\n\n{question}") -> str:
    """A question that stands alone, for retrieval only. Without history, or on any failure, the question itself."""
    if not history:
        return question
    told = "\n".join(f"{ROLE_LABELS.get(role, role)}: {text}" for role, text in history[-2 * REWRITE_PAIRS :])
    try:
        lines = [x.strip() for x in generate(prompt.format(conversation=told, question=question)).splitlines() if x.strip()]
    except Exception:  # the rewrite must never break a conversation
        return question
    return (lines[0].strip('"').strip() if lines else "") or question


@dataclass
class Conversation:
    """One session: what was said, and how to answer the next question."""

    retrieve: Callable[[str], str]
    generate: Generate
    system: str = ""
    history: list[tuple[str, str]] = field(default_factory=list)

    def ask(self, question: str) -> str:
        """Retrieve with the rewritten question, answer the original one, keep both turns and the last HISTORY of all."""
        found = self.retrieve(rewritten(question, self.history, self.generate))
        told = "\n".join(f"{role}: {text}" for role, text in self.history)
        answer = with_retry(self.generate, "\n\n".join(x for x in (self.system, told, found, question) if x))
        self.history = (self.history + [("user", question), ("model", answer)])[-HISTORY:]
        return answer


def judged(cases: DataFrame, judge: Callable[[str, str, str], dict]) -> DataFrame:
    """(query_id, text, context, answer) -> (query_id, faithful, answers, grade); nulls where the judge says nothing usable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
        truth = lambda x: x if isinstance(x, bool) else None
        for rows in batches:
            said = []
            for row in zip(*(c.to_pylist() for c in rows.columns[1:])):
                try:
                    said.append(judge(*row) or {})
                except Exception:  # a verdict is missing, the run goes on
                    said.append({})
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([truth(v.get("faithful")) for v in said], pa.bool_()), pa.array([truth(v.get("answers")) for v in said], pa.bool_()), pa.array([number(v.get("grade")) for v in said], pa.float64())], ["query_id", "faithful", "answers", "grade"])

    kind = cases.schema["query_id"].dataType.simpleString()
    return cases.select("query_id", "text", "context", "answer").mapInArrow(run, f"query_id {kind}, faithful boolean, answers boolean, grade double")


def client_address(forwarded: Column, peer: Column, trusted: bool) -> Column:
    """The first address of a forwarded header if the proxy is trusted, else the peer's."""
    first = F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    return F.when(F.lit(trusted) & (first != ""), first).otherwise(F.coalesce(peer, F.lit("-")))
