"""Exact dedup: binary fuse filters over an immutable snapshot screen new digests; positives meet exact buckets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import BROADCAST_IDS, by_ids, map_arrow, materialize
from talweg.session import remove, shared_folder

#: Filters are built by shard. A shard has about so many digests at most, and there are so many shards at least.
SHARD_KEYS = 50_000
LEAST_SHARDS = 1024
#: A group is hot if it has more than this part of all rows (one in so many).
HOT_PART = 1000
SALTS = 64
M64 = (1 << 64) - 1


def normal(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " ")


def _mixed(key: np.ndarray, seed: int) -> np.ndarray:
    h = (key + np.uint64(seed)).astype(np.uint64)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """A static 3-wise binary fuse filter with 8-bit fingerprints: about 9 bits a key, no false negatives."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three cells in neighbouring segments."""
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack((first, second, third), axis=1).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "FuseFilter":
        """keys: distinct 64-bit numbers."""
        n = len(keys)
        segment = 1 << max(2, min(18, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        slack = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
        segments = max(1, math.ceil(n * slack / segment) - 2)
        for seed in range(1, 1 << 20):
            h = _mixed(keys, seed * 0x9E3779B97F4A7C15 & M64)
            places = cls._places(h, segment, segments)
            size = segment * (segments + 2)
            count = np.bincount(places.ravel(), minlength=size).tolist()
            held = [0] * size  # the exclusive or of the keys' numbers in each cell
            rows = places.tolist()
            for i, row in enumerate(rows):
                for p in row:
                    held[p] ^= i
            single = [p for p in range(size) if count[p] == 1]
            order = []
            while single:
                p = single.pop()
                if count[p] != 1:
                    continue
                i = held[p]
                order.append((i, p))
                for q in rows[i]:
                    count[q] -= 1
                    held[q] ^= i
                    if count[q] == 1:
                        single.append(q)
            if len(order) == n:
                prints = cls._prints(h).tolist()
                cells = [0] * size
                for i, p in reversed(order):
                    a, b, c = rows[i]
                    cells[p] = prints[i] ^ cells[a] ^ cells[b] ^ cells[c] ^ cells[p]
                return cls(seed * 0x9E3779B97F4A7C15 & M64, segment, segments, np.array(cells, np.uint8))
            if seed % 10 == 0:
                segments += max(1, segments // 8)
        raise ValueError("keys are not distinct")

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys, self.seed)
        a, b, c = self._places(h, self.segment, self.segments).T
        return (self.cells[a] ^ self.cells[b] ^ self.cells[c]) == self._prints(h)

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.uint64).tobytes() + self.cells.tobytes()

    @classmethod
    def load(cls, data: bytes) -> "FuseFilter":
        seed, segment, segments = np.frombuffer(data, np.uint64, 3).tolist()
        return cls(seed, segment, segments, np.frombuffer(data, np.uint8, offset=24))


def _key(digest: Column) -> Column:
    """64 bits of a hex digest, as a bigint."""
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def _shard(digest: Column, shards: int) -> Column:
    return F.conv(F.substring(digest, 17, 8), 16, 10).cast("bigint") % shards


def _shards(count: int) -> int:
    return max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1, count / SHARD_KEYS))))


def _by_shard(rows: DataFrame, each: Callable, schema: str, order: list[str]) -> DataFrame:
    """Deal rows by shard and hand every complete shard to ``each``, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            shards = whole["shard"].to_numpy()
            if not len(shards):
                continue
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield from each(whole.slice(a, b - a))
            rest = whole.slice(cuts[-1])
        if rest is not None:
            yield from each(rest)

    return map_arrow(rows.repartition("shard").sortWithinPartitions("shard", *order), run, schema, rows=20_000)


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """(digest) distinct -> (shard, filter: binary): one static filter for each shard of the snapshot."""

    def each(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.unique(rows["key"].to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([rows["shard"][0].as_py()], pa.int64()), pa.array([FuseFilter.build(keys).dump()], pa.binary())], ["shard", "filter"])

    return _by_shard(snapshot.select(_shard(F.col("digest"), shards).alias("shard"), _key(F.col("digest")).alias("key")), each, "shard bigint, filter binary", [])


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(digest) -> (digest, positive): false is certain, true is to be checked in the exact bucket."""
    asked = incoming.select(_shard(F.col("digest"), shards).alias("shard"), F.lit(1).alias("kind"), "digest", _key(F.col("digest")).alias("key"), F.lit(None).cast("binary").alias("filter"))
    both = asked.unionByName(filters.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("bigint").alias("key"), "filter"))

    def each(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        first = rows["kind"][0].as_py() == 0
        keys = rows.slice(int(first))
        hits = FuseFilter.load(rows["filter"][0].as_py()).has(keys["key"].to_numpy().view(np.uint64)) if first else np.zeros(len(keys), bool)
        yield pa.RecordBatch.from_arrays([keys["digest"].combine_chunks(), pa.array(hits)], ["digest", "positive"])

    return _by_shard(both, each, "digest string, positive boolean", ["kind"])


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, tag) of every row; the tag tells rows with the same id apart."""
    return materialize(docs.select(F.col("doc_id").cast("bigint"), F.sha2(normal(F.col("text")), 256).alias("digest"), F.monotonically_increasing_id().alias("tag")))


def _grouped(base: DataFrame) -> DataFrame:
    """(doc_id, digest, tag) -> (digest, first, n); rows without an id come last."""
    return base.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"), F.count("*").alias("n"))


class Snapshot:
    """An immutable set of texts in a folder: the groups of its digests, and one fuse filter for each shard of them.

    Batches that come later are screened by the stored filters; only positives read the stored groups.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.shards: int = spark.read.parquet(f"{path}/size").first().shards

    @classmethod
    def write(cls, base: DataFrame, path: str) -> "Snapshot":
        """Store the snapshot of rows (doc_id, digest, tag). What says how many shards there are is written last and commits it."""
        spark = base.sparkSession
        _grouped(base).write.parquet(f"{path}/groups")
        groups = spark.read.parquet(f"{path}/groups")
        shards = _shards(groups.count())
        build_filters(groups, shards).write.parquet(f"{path}/filters")
        spark.range(1).select(F.lit(shards).alias("shards")).write.parquet(f"{path}/size")
        return cls(spark, path)

    def groups(self) -> DataFrame:
        return self.spark.read.schema("digest string, first struct<none:boolean,doc_id:bigint,tag:bigint>, n bigint").parquet(f"{self.path}/groups")

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard bigint, filter binary").parquet(f"{self.path}/filters")

    def merged(self, base: DataFrame) -> DataFrame:
        """The groups (digest, first, n) of the snapshot and a new batch (doc_id, digest, tag) together.

        The batch's own duplicates are grouped apart; its digests are screened, and positives join the exact buckets.
        """
        batch = materialize(_grouped(base))
        marked = materialize(batch.join(screen(batch, self.filters(), self.shards), "digest"))
        positives = marked.filter("positive").select("digest", F.col("first").alias("f"), F.col("n").alias("m"))
        buckets = self.groups().join(positives, "digest", "full")  # a false positive meets no bucket and stays a group of its own
        whole = buckets.select("digest", F.least("first", "f").alias("first"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return whole.unionByName(marked.filter("NOT positive").select("digest", "first", "n"))


def unequal_digests(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests of groups whose texts aren't all the same bytes; only texts of groups of two or more are compared.

    The keys of these groups are counted and, up to BROADCAST_IDS of them, broadcast, so that other texts aren't
    shuffled; more of them meet the texts by key and salt. Either way each task first reduces a group to its different texts.
    """
    texts = docs.select(normal(F.col("text")).alias("text")).withColumn("digest", F.sha2("text", 256)).withColumn("key", _key(F.col("digest")))
    several = groups.filter("n > 1").select(_key(F.col("digest")).alias("key")).distinct()
    if several.count() <= BROADCAST_IDS:
        met = texts.join(F.broadcast(several), "key", "left_semi")
    else:
        salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = texts.withColumn("salt", (F.rand(9) * SALTS).cast("int")).join(salted, ["key", "salt"], "left_semi")
    return met.select("digest", "text").distinct().groupBy("digest").count().filter("count > 1").select("digest")


def assign(docs: DataFrame, snapshot_share: float = 0.5) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, keep_id, group_size, kept, text_sha256), a row per row.

    The rows below ``snapshot_share`` of the range of ids are stored as an immutable snapshot, the others are the new
    batch that is screened against it; the result is the same for any share. The texts of every group of two or
    more are compared byte by byte. Digests that stand for different texts are replaced by the texts themselves.

    Null texts equal empty ones. Rows without an id come after all ids; of rows that share the smallest id one is kept.
    An empty table gives no rows; other columns are ignored.
    """
    base = digested(docs)
    ends = base.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).first()
    pivot = 0 if ends.a is None else ends.a + math.ceil((ends.b - ends.a + 1) * snapshot_share)
    old = F.col("doc_id").isNotNull() & (F.col("doc_id") < pivot)
    folder = f"{shared_folder(docs.sparkSession)}/snapshot-{uuid4().hex}"
    groups = materialize(Snapshot.write(base.filter(old), folder).merged(base.filter(~old)))
    remove(docs.sparkSession, folder)
    unequal = materialize(unequal_digests(docs, groups))
    if not unequal.isEmpty():  # no such pair of texts is known; kept so that equality never rests on a digest
        return _assign_by_text(docs, unequal)
    return _labelled(base, groups, ends.n)


def assign_batch(batch: DataFrame, snapshot: Snapshot, snapshot_docs: DataFrame) -> DataFrame:
    """As assign(), for the rows of a batch against a stored snapshot, whose texts are read for the byte checks only."""
    base = digested(batch).withColumn("tag", F.col("tag") + F.lit(1 << 62))  # unlike any tag of the snapshot
    groups = materialize(snapshot.merged(base))
    both = batch.select("doc_id", "text").unionByName(snapshot_docs.select("doc_id", "text"))
    unequal = materialize(unequal_digests(both, groups))
    if not unequal.isEmpty():
        raise ValueError("different texts share a digest; such a snapshot must be rebuilt together with the batch by assign()")
    return _labelled(base, groups, base.count())


def _labelled(base: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """Every row with its group. Groups of over a thousandth of all rows, which are under a thousand, are broadcast; the others joined."""
    hot = F.col("n") * HOT_PART > rows
    few = groups.filter(hot).withColumnRenamed("digest", "__digest")
    tried = base.join(F.broadcast(few), F.col("digest") == F.col("__digest"), "left")
    found = tried.filter("n IS NOT NULL").drop("__digest")
    rest = tried.filter("n IS NULL").select("doc_id", "digest", "tag").join(groups.filter(~hot), "digest")
    met = found.unionByName(rest)
    return met.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").cast("bigint").alias("group_size"), (F.col("tag") == F.col("first.tag")).alias("kept"), F.substring("digest", 1, 64).alias("text_sha256"))


def _assign_by_text(docs: DataFrame, unequal: DataFrame) -> DataFrame:
    """The same; rows of the digests that failed the byte check are grouped by digest and text."""
    few = F.broadcast(unequal.select(F.col("digest").alias("__unequal"), F.lit(True).alias("__marked")))  # colliding digests
    text = normal(F.col("text"))
    own = docs.select(F.col("doc_id").cast("bigint"), text.alias("t"), F.sha2(text, 256).alias("d")).join(few, F.col("d") == F.col("__unequal"), "left")
    key = F.concat("d", F.when(F.col("__marked"), F.col("t")).otherwise(""))
    base = materialize(own.select("doc_id", key.alias("digest"), F.monotonically_increasing_id().alias("tag")))
    return _labelled(base, materialize(_grouped(base)), base.count())


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without exact copies: of equal texts the row with the smallest doc_id stays, with all its columns.

    Null texts equal empty ones. Rows without an id come after all ids; of rows with one id and equal texts one stays.
    An empty table gives no rows. Only ids are shuffled while those that go are few enough to be broadcast; rows with
    repeated ids or without one, of which some stay and some go, are told apart by their texts' digests.
    """
    rows = materialize(assign(docs))
    by_id = materialize(rows.groupBy("doc_id").agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go")).filter("go > 0"))
    stay = by_ids(docs, by_id.filter("stay = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")), "left_anti")
    mixed = by_id.filter("stay > 0 OR doc_id IS NULL").select(F.col("doc_id").alias("__id"))
    if mixed.isEmpty():
        return stay
    named, none = mixed.filter("__id IS NOT NULL"), not mixed.filter("__id IS NULL").isEmpty()
    clear = by_ids(stay.filter("doc_id IS NOT NULL") if none else stay, named, "left_anti")
    odd = by_ids(stay, named, "left_semi")
    odd = odd.unionByName(stay.filter("doc_id IS NULL")) if none else odd
    odd = odd.withColumn("__digest", F.sha2(normal(F.col("text")), 256))
    kept = rows.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept"))
    odd = odd.join(kept, odd["doc_id"].cast("bigint").eqNullSafe(F.col("__id")) & (odd["__digest"] == F.col("__kept")), "left_semi")
    return clear.unionByName(odd.dropDuplicates(["doc_id", "__digest"]).drop("__digest"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256, row_number() OVER () AS r FROM documents
), k AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r) AS i,
         count(*) OVER (PARTITION BY text_sha256) AS n, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, i = 1 AS kept, text_sha256 FROM k
"""
