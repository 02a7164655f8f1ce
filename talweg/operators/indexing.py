"""Incremental index: fingerprints, manifest, difference, reuse, versions."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators import chunking
from talweg.session import remove, shared_folder

VERSION = 3
CONFIG_SCHEMA = "version int, embedding_model string, embedding_dim int, chunk_size int, chunk_overlap int"
MANIFEST_SCHEMA = "doc string, hash string, n_chunks int"
CHUNK_SCHEMA = "chunk_no int, text string, body string, header string, section string, page int, doc string"
#: Parts of the chunk table that are written apart. A change of one document writes one of them again.
BUCKETS = 256


@dataclass(frozen=True)
class IndexConfig:
    version: int = VERSION
    embedding_model: str = "gemini-embedding-001"
    embedding_dim: int = 768
    chunk_size: int = chunking.SIZE
    chunk_overlap: int = chunking.OVERLAP


def fingerprint(content: Column) -> Column:
    """SHA-256 of the bytes, in hex."""
    return F.sha2(content.cast("binary"), 256)


def difference(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc, hash) twice -> (doc, status): unchanged, new, changed or removed."""
    met = current.select("doc", F.col("hash").alias("now")).join(manifest.select("doc", F.col("hash").alias("then")), "doc", "full")
    status = F.when(F.col("now").isNull(), "removed").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return met.select("doc", status.alias("status"))


def is_stale(current: DataFrame, manifest: DataFrame | None) -> bool:
    """Whether there is no usable index, or its documents aren't the current ones (doc, hash)."""
    return manifest is None or not difference(current, manifest).filter("status <> 'unchanged'").isEmpty()


def reusable(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose stored chunks are as many as their manifest says."""
    return chunks.groupBy("doc").agg(F.count("*").alias("n")).join(manifest, (F.col("n") == F.col("n_chunks")) & (chunks["doc"] == manifest["doc"]), "left_semi").select("doc")


def chunks_per_document(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc) and (doc, ...) -> (doc, n_chunks); documents without chunks have 0."""
    counts = chunks.groupBy("doc").agg(F.count("*").alias("n"))
    return docs.select("doc").join(counts, "doc", "left").select("doc", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with chunk_id: their place in an order over all of them, from 0, the same in every build.

    A range shuffle sorts them; partitions are counted, and the driver sees these counts only.
    """
    shared_folder(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()
    before, sums = 0, [F.lit(-1), F.lit(0).cast("bigint")]
    for r in placed.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        sums += [F.lit(r["__part"]), F.lit(before).cast("bigint")]
        before += r.n
    return placed.withColumn("chunk_id", F.create_map(*sums)[F.col("__part")] + F.col("__at")).drop("__part", "__at")


def _bucket(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(BUCKETS)).cast("int")


class Index:
    """An index in a folder, in versions: a build writes the buckets of the chunk table that it touches, then the manifest and
    where every bucket is, then the configuration, which commits the version. Until then readers see the last one whole.
    """

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig = IndexConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    # versions

    def _names(self, folder: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Committed versions, the oldest first."""
        return sorted(int(v) for v in self._names("commits") if v.isdigit() and "_SUCCESS" in self._names(f"commits/{v}/config"))

    def _committed(self, name: str, schema: str) -> DataFrame | None:
        """A table of the last version, or null if there is none or it can't be read."""
        versions = self.versions()
        if not versions:
            return None
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.path}/commits/{versions[-1]}/{name}")
            found.agg(*[F.max(c) for c in found.columns]).collect()  # a corrupt file shows now
            return found
        except (PySparkException, Py4JJavaError):
            return None

    def manifest(self) -> DataFrame | None:
        """The manifest, or null if there is none, it can't be read, or it was made with another configuration."""
        config = self._committed("config", CONFIG_SCHEMA)
        if config is None or [r.asDict() for r in config.collect()] != [asdict(self.config)]:
            return None
        return self._committed("manifest", MANIFEST_SCHEMA)

    def chunks(self) -> DataFrame | None:
        """The chunks of the last version."""
        places = self._committed("places", "bucket int, version int")
        if places is None:
            return None
        paths = [f"{self.path}/data/{r.version}/bucket={r.bucket}" for r in places.collect()]  # BUCKETS at most
        return self.spark.read.schema(CHUNK_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], CHUNK_SCHEMA)

    def ordered_chunks(self) -> DataFrame | None:
        """The chunks with chunk_id, by document and number."""
        found = self.chunks()
        return None if found is None else numbered(found, "doc", "chunk_no")

    def stale(self, docs: DataFrame) -> bool:
        """Whether (doc, text) isn't what the index holds, or the index was made with another configuration."""
        return is_stale(docs.select(F.col("doc").cast("string").alias("doc"), fingerprint(F.coalesce("text", F.lit(""))).alias("hash")), self.manifest())

    # writing

    def build(self, docs: DataFrame, force: bool = False) -> dict[str, int]:
        """Bring the index up to (doc, text): only new and changed documents are chunked, removed ones go."""
        return self._write(docs, True, force)

    def update(self, docs: DataFrame) -> dict[str, int]:
        """As build(), but documents that aren't among (doc, text) stay as they are."""
        return self._write(docs, False, False)

    def _write(self, docs: DataFrame, whole: bool, force: bool) -> dict[str, int]:
        current = docs.select(F.col("doc").cast("string").alias("doc"), "text", fingerprint(F.coalesce("text", F.lit(""))).alias("hash")).persist()
        manifest = None if force else self.manifest()
        stored = None if manifest is None else self.chunks()
        if manifest is None or stored is None:
            manifest, stored = self.spark.createDataFrame([], MANIFEST_SCHEMA), self.spark.createDataFrame([], CHUNK_SCHEMA)
        states = difference(current, manifest)
        states = (states if whole else states.filter("status <> 'removed'")).persist()
        gone = states.filter("status = 'removed'")
        kept = states.filter("status = 'unchanged'").join(reusable(stored, manifest), "doc", "left_semi").select("doc")
        pending = current.join(kept, "doc", "left_anti").persist()
        touched = pending.select("doc").unionByName(gone.select("doc")).select(_bucket(F.col("doc")).alias("bucket")).distinct().persist()
        stay = stored.join(pending.select("doc").unionByName(gone.select("doc")), "doc", "left_anti").withColumn("bucket", _bucket(F.col("doc")))
        fresh = chunking.chunks(pending, self.config.chunk_size, self.config.chunk_overlap).withColumn("bucket", _bucket(F.col("doc")))
        version = max([0, *(int(v) for f in ("commits", "data") for v in self._names(f) if v.isdigit())]) + 1
        fresh.unionByName(stay.join(F.broadcast(touched), "bucket", "left_semi")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")  # BUCKETS rows

        written = [(int(n.partition("=")[2]), version) for n in self._names(f"data/{version}") if n.startswith("bucket=")]
        changed = {r.bucket for r in touched.collect()}
        places = None if stored.isEmpty() else self._committed("places", "bucket int, version int")
        written += [(r.bucket, r.version) for r in (places.collect() if places is not None else []) if r.bucket not in changed]
        counts = fresh.groupBy("doc").agg(F.count("*").alias("n"))
        entries = pending.join(counts, "doc", "left").select("doc", "hash", F.coalesce("n", F.lit(0)).cast("int").alias("n_chunks"))
        others = manifest.join(pending.select("doc").unionByName(gone.select("doc")), "doc", "left_anti")
        entries.unionByName(others.select("doc", "hash", "n_chunks")).write.parquet(f"{self.path}/commits/{version}/manifest")
        self.spark.createDataFrame(written, "bucket int, version int").write.parquet(f"{self.path}/commits/{version}/places")
        found = {r.status: r["count"] for r in states.groupBy("status").count().collect()} | {"pending": pending.count(), "buckets": len(changed)}
        self.spark.createDataFrame([asdict(self.config)], CONFIG_SCHEMA).write.parquet(f"{self.path}/commits/{version}/config")
        for frame in (current, states, pending, touched):
            frame.unpersist()
        return found

    def vacuum(self) -> None:
        """Delete what the last version doesn't use: older commits, unfinished ones, and data that no bucket points to."""
        versions = self.versions()
        places = self._committed("places", "bucket int, version int")
        if not versions or places is None:
            return
        used = {r.version for r in places.collect()}
        for v in self._names("commits"):
            if v != str(versions[-1]):
                remove(self.spark, f"{self.path}/commits/{v}")
        for v in self._names("data"):
            if not v.isdigit() or int(v) not in used:
                remove(self.spark, f"{self.path}/data/{v}")

    def delete(self) -> None:
        remove(self.spark, self.path)
