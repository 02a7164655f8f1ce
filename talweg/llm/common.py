"""What the corpus operators share: lineage cuts, joins by ids, small batches and the bounded training samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.session import shared_folder

#: Rows that a function sees at once. Spark bounds the bytes of the batches that it cuts these from.
BATCH_ROWS = 256
#: Ids that are broadcast at most: 16 bytes each, and as much again for their table.
BROADCAST_IDS = 1 << 21
#: ASCII white space, as the contracts count it: space and the characters 9 to 13.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` whose function sees few rows at once; the session's settings stay as they are."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.slice(at, rows) for batch in batches for at in range(0, max(batch.num_rows, 1), rows))

    return df.mapInArrow(small, schema)


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with distinct ids (__id), none of them null.

    While the ids are few they are broadcast, after they have been counted, and texts stay where they are; more ids
    than BROADCAST_IDS meet the texts in a shuffle by id.
    """
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].cast("bigint") == F.col("__id"), how)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(id_text(doc_id).cast("binary")) % folds


def spread(text: Column, seed: Column, most: int, parts: int = 4) -> Column:
    """A text of up to ``most`` characters whole; a longer one as slices from all over it, without the words cut at their ends.

    The text is dealt into equal parts; each gives one slice, at a place that the seed chooses.
    """
    size, n = most // parts, F.length(text)
    move = F.pmod(F.xxhash64(seed, F.lit(23)), F.lit(1 << 20)) / F.lit(1 << 20)
    starts = [F.floor((F.lit(k) + move) / parts * (n - size)).cast("int") + 1 for k in range(parts)]
    slices = [F.regexp_replace(F.substring(text, at, F.lit(size)), r"^[^ \t-\r]*[ \t-\r]+|[ \t-\r]+[^ \t-\r]*$", "") for at in starts]
    return F.when(n <= most, text).otherwise(F.array_join(F.array(*slices), "\n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, *, folds: int, held: int, rows: int) -> DataFrame:
    """At most about ``rows`` labelled documents (doc_id, text, y) outside the held-out fold, short or long.

    The labels are thinned by a hash of the id until ``rows`` remain, whatever their number, and only
    then meet the texts: the side that is broadcast is bounded by ``rows``, never by the corpus.
    Labels without an id, and labels outside 0 and 1, teach nothing. A document that is labelled more than
    once counts with its largest label; a repeated document row counts once.
    """
    usable = labels.select("doc_id", F.col(target).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
    known = usable.count()
    share = min(1.0, rows / max(known, 1))
    thinned = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20))).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(thinned), "doc_id").dropDuplicates(["doc_id"])
