"""Dense search: exact by matrix blocks, approximate by stored codes, and the choice between both."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.session import remove

#: From so many rows on, "auto" searches approximately.
APPROXIMATE_FROM = 50_000
#: Queries of one matrix product at most.
QUERY_BLOCK = 1024
#: Codes: parts of a vector, centroids of a part (one byte), rows that train them at most, and rounds of training.
PARTS, CENTROIDS, SAMPLE, ROUNDS = 16, 256, 20_000, 6
#: Rows that are scored exactly for each one asked for.
SHORTLIST = 10


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


class Best:
    """The best rows for each query: of rows x queries of similarities, added part by part, only these are held.

    Ties go to the smaller key. Keys are whole numbers or strings.
    """

    def __init__(self, ids: list, top: int, above: float = -2.0):
        self.ids, self.top, self.above = ids, top, above
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.least = np.full(len(ids), -np.inf)
        self.kind: pa.DataType = pa.int64()

    def add(self, keys: pa.Array, sims: np.ndarray) -> None:
        self.kind = keys.type
        names = keys.to_numpy(zero_copy_only=False)
        names = names.astype(str) if names.dtype == object else names
        self.held = self.held or [(names[:0], np.zeros(0))] * len(self.ids)
        for j, (own, scores) in enumerate(self.held):
            rows = np.flatnonzero((sims[:, j] > self.above) & (sims[:, j] >= self.least[j]))
            if len(rows):
                own, scores = np.concatenate((own, names[rows])), np.concatenate((scores, sims[rows, j]))
                order = np.lexsort((own, -scores))[: self.top]
                self.held[j] = own[order], scores[order]
                self.least[j] = scores[order[-1]] if len(order) == self.top else self.least[j]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, score)."""
        for at in range(0, len(self.held), 64):
            some = self.held[at : at + 64]
            counts = [len(own) for own, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids[at : at + 64], counts), pa.int64()), pa.array(np.concatenate([own for own, _ in some]).tolist(), self.kind), pa.array(np.concatenate([s for _, s in some]))], ["query_id", "doc_id", "score"])


def best_rows(parts: Iterable[tuple[pa.Array, np.ndarray]], ids: list, top: int, above: float = -2.0) -> Iterator[pa.RecordBatch]:
    """The best rows of a task for each query, out of parts (keys, rows x queries of similarities): (query_id, doc_id, score)."""
    best = Best(ids, top, above)
    for keys, sims in parts:
        best.add(keys, sims)
    yield from best.batches()


def _ranked(candidates: DataFrame, key: str, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def exact_topk(vectors: DataFrame, queries: np.ndarray, ids: list[int], top: int) -> DataFrame:
    """(vec_id, embedding) and query rows -> (query_id, vec_id, score, rank) by cosine.

    Queries are the caller's, a matrix on the driver. Each Arrow batch is one matrix product; a task keeps its best
    rows, and these alone are shuffled, by query. Zero vectors score zero.
    """
    q = unit(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = ((b.column(0), np.round(unit(_matrix(b.column(1))) @ q.T, 6)) for b in batches if b.num_rows and ids)
        for found in best_rows(scored, ids, top):
            yield found.rename_columns(["query_id", "vec_id", "score"])

    return _ranked(vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score double"), "vec_id", top)


def named_rows(vectors: DataFrame, ids: list[int]) -> tuple[list[int], np.ndarray]:
    """Those of a few named rows that exist and have a vector, in the order of the names, and their vectors."""
    found = {r.vec_id: r.embedding for r in vectors.filter(F.col("vec_id").isin(*ids) & F.col("embedding").isNotNull()).collect()}
    there = [i for i in ids if i in found]
    return there, np.array([found[i] for i in there], np.float64) if there else np.zeros((0, 1))


def by_blocks(vectors: DataFrame, every: int, search: Callable[[list[int], np.ndarray], DataFrame]) -> DataFrame:
    """search(ids, matrix) for all rows whose id is divisible by ``every``, so many of them at once that memory is bounded."""
    rows = vectors.filter((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull()).select("vec_id").distinct().collect()
    ids = sorted(r.vec_id for r in rows)
    found = [search(*named_rows(vectors, ids[i : i + QUERY_BLOCK])) for i in range(0, max(len(ids), 1), QUERY_BLOCK)]
    return reduce(DataFrame.unionByName, found)


# approximate


def trained_books(sample: np.ndarray) -> np.ndarray:
    """Centroids of each part of unit vectors, by k-means: parts x centroids x dimensions of a part."""
    parts = np.split(_padded(sample), PARTS, axis=1)
    rng = np.random.default_rng(0)
    first = np.sort(rng.choice(len(sample), min(CENTROIDS, len(sample)), replace=False))
    books = []
    for rows in parts:
        centres = rows[first].copy()
        for _ in range(ROUNDS):
            of = _nearest(rows, centres)
            counts = np.bincount(of, minlength=len(centres))
            sums = np.stack([np.bincount(of, weights=rows[:, d], minlength=len(centres)) for d in range(rows.shape[1])], axis=1)
            centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        books.append(centres)
    return np.stack(books)


def _padded(rows: np.ndarray) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % PARTS)))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * rows @ centres.T, axis=1)


class CodeIndex:
    """Vectors as PARTS bytes each: the nearest centroid of every part. Stored in a folder and used again while it fits.

    A search scans the codes, a sixteenth of the bytes of 64 floats, keeps SHORTLIST times the rows asked for, and scores
    these alone by their vectors. Every row with a vector is in the index; only the centroids come from a sample.
    """

    SIZE = "rows bigint, print bigint, books array<double>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.size = spark.read.schema(self.SIZE).parquet(f"{path}/size").first()
        if self.size is None:
            raise ValueError(f"{path} is incomplete")
        books = np.array(self.size.books, np.float64)  # dimensions of a part, then the centroids
        self.books = books[1:].reshape(PARTS, -1, int(books[0]))

    @staticmethod
    def state(vectors: DataFrame) -> tuple[int, int]:
        """The number of rows with a vector, and a hash of all of them."""
        seen = vectors.filter(F.col("embedding").isNotNull()).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("vec_id", "embedding")).alias("x")).first()
        return seen.n, seen.x or 0

    @classmethod
    def ready(cls, vectors: DataFrame, path: str) -> "CodeIndex":
        """The index of a folder if it is that of these rows, else a new one in its place."""
        state = cls.state(vectors)
        try:
            found = cls(vectors.sparkSession, path)
            if (found.size.rows, found.size.print) == state:
                return found
        except (AnalysisException, ValueError):  # none there, or not finished
            pass
        return cls.build(vectors, path, state)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, state: tuple[int, int]) -> "CodeIndex":
        spark = vectors.sparkSession
        remove(spark, path)
        rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("bigint"), "embedding")
        share = min(1.0, SAMPLE / max(1, state[0]))
        some = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy("vec_id").collect()
        books = trained_books(unit(np.array([r.embedding for r in some], np.float64))) if some else np.zeros((PARTS, 1, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    parts = np.split(_padded(unit(_matrix(batch.column(1)))), PARTS, axis=1)
                    codes = np.stack([_nearest(x, c) for x, c in zip(parts, books)], axis=1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "code"])

        rows.mapInArrow(run, "vec_id bigint, code binary").write.parquet(f"{path}/codes")
        stored = [float(books.shape[2]), *books.ravel().tolist()]
        spark.createDataFrame([(*state, stored)], cls.SIZE).write.parquet(f"{path}/size")  # commits the rest
        return cls(spark, path)

    def codes(self) -> DataFrame:
        return self.spark.read.schema("vec_id bigint, code binary").parquet(f"{self.path}/codes")

    def shortlist(self, queries: np.ndarray, ids: list[int], size: int) -> DataFrame:
        """(query_id, vec_id, score): the best rows by their codes."""
        q, books = _padded(unit(queries)), self.books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def scored() -> Iterator[tuple[pa.Array, np.ndarray]]:
                for batch in batches:
                    if batch.num_rows and ids:
                        codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)
                        yield batch.column(0), np.concatenate([books[p][codes[:, p]] for p in range(PARTS)], axis=1) @ q.T

            for found in best_rows(scored(), ids, size):
                yield found.rename_columns(["query_id", "vec_id", "score"])

        return _ranked(self.codes().mapInArrow(run, "query_id bigint, vec_id bigint, score double"), "vec_id", size)

    def topk(self, vectors: DataFrame, queries: np.ndarray, ids: list[int], top: int) -> DataFrame:
        """As exact_topk(), among the shortlist of each query. ``ids`` are a block of queries, so the pairs to score are bounded."""
        if not ids:
            return exact_topk(vectors, queries, ids, top)
        q, place = unit(queries), {i: k for k, i in enumerate(ids)}
        pairs = self.shortlist(queries, ids, SHORTLIST * top).select("query_id", F.col("vec_id").alias("near"))
        pairs = F.broadcast(pairs) if len(ids) * SHORTLIST * top <= QUERY_BLOCK * 1000 else pairs  # this many at most
        met = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("bigint"), "embedding").join(pairs, F.col("vec_id") == F.col("near")).select("query_id", "vec_id", "embedding")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    asked = q[[place[i] for i in batch.column(0).to_pylist()]]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round((asked * unit(_matrix(batch.column(2)))).sum(axis=1), 6))], ["query_id", "vec_id", "score"])

        return _ranked(met.mapInArrow(run, "query_id bigint, vec_id bigint, score double").dropDuplicates(["query_id", "vec_id"]), "vec_id", top)


def search(vectors: DataFrame, queries: np.ndarray, ids: list[int], top: int, backend: str = "auto", path: str | None = None) -> DataFrame:
    """Exact or approximate search; "auto" goes by the number of rows. ``path`` is where the codes are, or come to be."""
    if backend == "auto":
        backend = "approximate" if path and vectors.count() > APPROXIMATE_FROM else "exact"
    if backend == "exact":
        return exact_topk(vectors, queries, ids, top)
    if backend != "approximate" or not path:
        raise ValueError(f"unknown backend, or no folder for it: {backend}")
    return CodeIndex.ready(vectors, path).topk(vectors, queries, ids, top)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(recall, queries): the part of the exact neighbours that the other ranking has too."""
    a = exact.select("query_id", "vec_id")
    both = a.join(approximate.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"), F.count_distinct("query_id").alias("queries"))


def compared(vectors: DataFrame, path: str, *, asked: int = 50, noise: float = 0.05, top: int = 4, repeats: int = 3) -> dict[str, dict[str, float]]:
    """Backend -> milliseconds a query and recall, asking for up to ``asked`` rows of the table with noise added (fixed seed)."""
    ids = sorted(r.vec_id for r in vectors.filter(F.col("embedding").isNotNull()).select("vec_id").orderBy(F.xxhash64("vec_id")).limit(asked).collect())
    ids, rows = named_rows(vectors, ids)
    noisy = unit(rows + np.random.default_rng(0).normal(0, noise, rows.shape))
    CodeIndex.ready(vectors, path)
    found: dict[str, dict[str, float]] = {}
    exact = None
    for backend in ("exact", "approximate"):
        spent = []
        for _ in range(repeats):
            began = time.perf_counter()
            rows_found = {(r.query_id, r.vec_id) for r in search(vectors, noisy, ids, top, backend, path).collect()}  # asked x top
            spent.append(time.perf_counter() - began)
        exact = rows_found if exact is None else exact
        found[backend] = {"ms_per_query": 1000 * sum(spent) / repeats / max(1, len(ids)), "recall": len(exact & rows_found) / max(1, len(exact))}
    return found
