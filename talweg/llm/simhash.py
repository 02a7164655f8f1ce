"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import as_bytes, by_ids, map_arrow, materialize
from talweg.llm.graph import connected_components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Blocks of the 64 bits. Pairs at distance d agree on at least BLOCKS - d of them.
BLOCKS = 5
#: Fingerprints that one block may hold before it is divided by further blocks.
CROWD = 2048
FULL = (1 << 64) - 1
#: The bits of each byte value, first bit first, and where each of eight bytes counts.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)
BYTE_PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of a UTF-8 text: a bit is set if it is set in over half the hashes.

    Null, empty and blank texts have fingerprint 0; a text of fewer than ``size`` words is one shingle.
    """
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_digest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())])
    places = np.frombuffer(hashes, np.uint8).reshape(-1, 8) + BYTE_PLACES
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes) // 8).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp: bigint), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(x)) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, fp bigint")


def _parts(bits: int, count: int) -> list[int]:
    """The set bits of a mask, dealt into ``count`` runs of nearly equal length."""
    places = [i for i in range(64) if bits >> i & 1]
    cuts = [round(k * len(places) / count) for k in range(count + 1)]
    return [sum(1 << i for i in places[a:b]) for a, b in zip(cuts, cuts[1:])]


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks such that any two values within ``distance`` agree under one at least (pigeonhole)."""
    parts = _parts(FULL, blocks)
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def finer_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """The same promise for values that agree under ``mask`` already: one more part of the other bits."""
    return [mask | part for part in _parts(FULL & ~mask, distance + 1)]


def _blocked(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(fp) -> (mask, value, fp), a row per mask."""
    spread = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])).alias("mask"))
    return spread.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def _divided(rows: DataFrame, crowd: int, distance: int) -> DataFrame:
    """Replace blocks of more than ``crowd`` fingerprints by finer blocks, until none is left.

    A block with r free bits holds at most 2^r fingerprints, so this ends whatever the data.
    """
    done = None
    while True:
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("size")).filter(F.col("size") > crowd)
        large = materialize(sizes.select("mask", "value"))
        masks = [r.mask for r in large.select("mask").distinct().collect()]  # a number fixed by the masks, not by the data
        if not masks:
            return rows if done is None else done.unionByName(rows)
        calm = rows.join(large, ["mask", "value"], "left_anti")
        done = calm if done is None else done.unionByName(calm)
        finer = {m: finer_masks(m & FULL, distance) for m in masks}
        cases = F.create_map(*[x for m, fine in finer.items() for x in (F.lit(m).cast("bigint"), F.array(*[F.lit(_signed(f)).cast("bigint") for f in fine]))])
        spread = rows.join(large, ["mask", "value"]).select("fp", F.explode(cases[F.col("mask")]).alias("mask"))
        rows = materialize(spread.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp"))


def forest(values: np.ndarray, distance: int = DISTANCE) -> tuple[list[int], list[int]]:
    """Edges that connect what links within ``distance``, at most one per value: (value, its root)."""
    left = values
    nodes: list[int] = []
    roots: list[int] = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                found = left[near]
                nodes += found.tolist()
                roots += [int(root)] * len(found)
                queue += list(found)
                left = left[~near]
    return nodes, roots


def _links(rows: DataFrame, distance: int) -> DataFrame:
    """Forest edges (a, b) of every block. Blocks arrive sorted, one after the other; alone ones are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 3), np.int64)

        def edges(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Every complete block of sorted rows."""
            new = np.flatnonzero((block[1:, :2] != block[:-1, :2]).any(axis=1)) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(block)]))
            fps = block[:, 2].view(np.uint64) if block[:, 2].flags.c_contiguous else np.ascontiguousarray(block[:, 2]).view(np.uint64)
            two = ends - starts == 2
            a, b = fps[starts[two]], fps[starts[two] + 1]
            near = np.bitwise_count(a ^ b) <= distance
            nodes, roots = [a[near].view(np.int64)], [b[near].view(np.int64)]
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                x, y = forest(fps[s:e], distance)
                nodes.append(np.array(x, np.uint64).view(np.int64))
                roots.append(np.array(y, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = np.concatenate((rest, rows))
            if not len(rows):
                continue
            last = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            rest = rows[cut:]
            if cut:
                yield from edges(rows[:cut])
        if len(rest):
            yield from edges(rest)

    dealt = rows.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return map_arrow(dealt, run, "a bigint, b bigint", rows=50_000)


def near_groups(docs: DataFrame, *, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp, component_id), one row per row of docs.

    Equal fingerprints are one node, however many rows share it. The nodes are joined on blocks, verified by
    Hamming distance, and connected. component_id is the smallest doc_id that can be reached; rows without
    an id take part and get null only if no row of their component has an id. Repeated rows come out
    repeatedly; an empty table gives an empty table; other columns are ignored.
    """
    base = materialize(fingerprints(docs))
    nodes = base.groupBy("fp").agg(F.min("doc_id").alias("least"))
    blocked = _blocked(nodes.select("fp"), block_masks(distance, blocks))
    roots = connected_components(_links(_divided(blocked, crowd, distance), distance))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.select("fp", "root").join(least, "root").select("fp", "component_id")
    return base.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without near-copies: of each component the row with the smallest doc_id stays.

    Rows that share a doc_id share their fate, and equal ones among those that stay become one. Rows without
    an id count as sharing one: all of them stay if a component has no row with an id. Null and blank texts are
    near-copies of each other. All columns stay, an empty table gives no rows. Only ids are shuffled while those that go
    are few enough to be broadcast.
    """
    groups = near_groups(docs)
    by_id = materialize(groups.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count("*").alias("n")))
    stay = by_ids(docs, by_id.filter("NOT stays AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")), "left_anti")
    if not by_id.filter("NOT stays AND doc_id IS NULL").isEmpty():
        stay = stay.filter("doc_id IS NOT NULL")
    repeated = by_id.filter("stays AND n > 1").select(F.col("doc_id").alias("__id"))
    if repeated.isEmpty():
        return stay
    named = repeated.filter("__id IS NOT NULL")
    once = by_ids(stay.filter("doc_id IS NOT NULL"), named, "left_anti")
    more = by_ids(stay, named, "left_semi").unionByName(stay.filter("doc_id IS NULL"))
    return once.unionByName(more.dropDuplicates())
