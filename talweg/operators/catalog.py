"""Collections: names, listing, paths, the residents of a least-recently-used cache."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators.chunking import join_pages
from talweg.operators.indexing import Index
from talweg.sources.files import extract, scan

#: Fixed formats: collection names and session ids.
NAME = r"\A[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}\z"
SESSION_ID = r"\A[0-9a-f]{32}\z"
RESIDENTS = 4


def is_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME), F.lit(False))


def paths(name: Column, root: str = "data") -> tuple[Column, Column]:
    """Where a collection keeps its documents and its index."""
    return F.concat(F.lit(f"{root}/"), name, F.lit("/docs")), F.concat(F.lit(f"{root}/"), name, F.lit("/rag_index"))


def listing(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """(collection, document), (collection) -> (collection, document, n_documents, indexed), a row a document, valid names only."""
    valid = documents.filter(is_name(F.col("collection"))).select("collection", "document")
    marks = indexed.select("collection").distinct().withColumn("indexed", F.lit(True))
    sizes = valid.groupBy("collection").agg(F.count("*").alias("n_documents")).join(marks, "collection", "left")
    return valid.join(sizes, "collection").select("collection", "document", "n_documents", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def residents(accesses: DataFrame, size: int = RESIDENTS) -> DataFrame:
    """(key, ts) -> the keys that an LRU cache of that size holds at the end, most recent first."""
    last = accesses.groupBy("key").agg(F.max("ts").alias("last_used"))
    return last.orderBy(F.col("last_used").desc(), "key").limit(size)


class FrameCache:
    """A driver-side LRU of persisted DataFrames."""

    def __init__(self, load: Callable[[str], DataFrame], size: int = RESIDENTS):
        self.load, self.size = load, size
        self.frames: OrderedDict[str, DataFrame] = OrderedDict()

    def get(self, name: str) -> DataFrame:
        if name in self.frames:
            self.frames.move_to_end(name)
            return self.frames[name]
        frame = self.frames[name] = self.load(name).persist()
        while len(self.frames) > self.size:
            self.frames.popitem(last=False)[1].unpersist()
        return frame

    def forget(self, name: str) -> None:
        if name in self.frames:
            self.frames.pop(name).unpersist()

    def clear(self) -> None:
        for name in list(self.frames):
            self.forget(name)

    def names(self) -> list[str]:
        return list(self.frames)


class Collections:
    """The collections under a root: each has a folder of documents and an index. Used indexes are kept, the oldest-used go first."""

    def __init__(self, spark: SparkSession, root: str, size: int = RESIDENTS):
        self.spark, self.root = spark, root.rstrip("/")
        self.cache = FrameCache(lambda name: self.index(name).chunks(), size)

    def _at(self, name: str, *more: str):
        if not isinstance(name, str) or not re.fullmatch(r"[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}", name):
            raise ValueError(f"not a collection's name: {name!r}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, name, *more)))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory()] if fs.exists(root) else []
        return sorted(n for n in found if re.fullmatch(r"[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}", n))

    def exists(self, name: str) -> bool:
        where, fs = self._at(name)
        return fs.exists(where)

    def create(self, name: str) -> bool:
        """False if it is there already."""
        where, fs = self._at(name, "docs")
        return not self.exists(name) and fs.mkdirs(where)

    def delete(self, name: str) -> bool:
        self.cache.forget(name)
        where, fs = self._at(name)
        return fs.delete(where, True)

    def documents(self, name: str) -> DataFrame:
        """(doc, text) of the collection's files, pages joined."""
        where, _ = self._at(name, "docs")
        return join_pages(extract(scan(self.spark, where.toString())))

    def index(self, name: str) -> Index:
        return Index(self.spark, self._at(name, "rag_index")[0].toString())

    def reindex(self, name: str, force: bool = False) -> dict[str, int]:
        self.cache.forget(name)
        return self.index(name).build(self.documents(name), force)

    def chunks(self, name: str) -> DataFrame:
        return self.cache.get(name)
