"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the others."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import as_bytes, map_arrow
from talweg.llm.pieces import spelled_out, splitter, tiktoken_classes

#: Pre-tokens that a worker remembers, and the characters that one of them may have: bounds on its memory, not on what it can encode.
REMEMBERED, REMEMBERED_LENGTH = 1 << 18, 64


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; arithmetic wraps around."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class PerfectHash:
    """A minimal perfect hash over distinct byte strings: every key has a slot of its own in 0..n-1.

    Keys fall into n/2 groups. Groups are placed from the largest: the first displacement that sends all of a
    group's keys to free slots is kept. Groups of one key take what is left directly (negative displacement).
    """

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: list[bytes]):
        n = self.size = len(keys)
        self.groups = max(1, n // 2)
        hashes = self._hashes(keys)
        group = (hashes % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        first = np.searchsorted(group[order], np.arange(self.groups + 1))
        sizes = np.diff(first)
        self.displacement = np.zeros(self.groups, np.int64)
        free = np.ones(n, bool)
        slots = np.zeros(n, np.int64)
        tries = np.arange(1, 257, dtype=np.uint64)
        for g in np.argsort(-sizes, kind="stable"):
            if sizes[g] < 2:
                break
            members = order[first[g] : first[g + 1]]
            base = np.uint64(0)
            while True:
                at = (_mixed(hashes[members][None, :] + (tries + base)[:, None] * self.STEP) % np.uint64(n)).astype(np.int64)
                fits = free[at].all(axis=1)
                for t in np.flatnonzero(fits):
                    if len(set(at[t].tolist())) == len(members):
                        break
                else:
                    base += np.uint64(len(tries))
                    continue
                self.displacement[g] = int(tries[t] + base)
                slots[members] = at[t]
                free[at[t]] = False
                break
        alone = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)[: len(alone)]
        self.displacement[alone] = -left - 1
        slots[order[first[alone]]] = left
        self.slots = slots

    @staticmethod
    def _hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)

    def find(self, keys: list[bytes]) -> list[int]:
        """The slot that each key would have; whether it is a key is for the caller to compare."""
        hashes = self._hashes(keys)
        moved = self.displacement[(hashes % np.uint64(self.groups)).astype(np.int64)]
        hashed = (_mixed(hashes + np.maximum(moved, 0).astype(np.uint64) * self.STEP) % np.uint64(self.size)).astype(np.int64)
        return np.where(moved < 0, -moved - 1, hashed).tolist()


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id. Ids are 0..n-1 without gaps."""
    with open(path, "rb") as file:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    return [ranked[i] for i in range(len(ranked))]


class Codec:
    """Encodes and decodes texts as the rank file and the pattern say, without special tokens.

    The pattern's Unicode classes are spelled out as ranges on the driver, so every worker splits alike.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, spelled_out(pattern, tiktoken_classes())
        self.hash = PerfectHash(tokens)
        self.at = [0] * len(tokens)
        for i, slot in enumerate(self.hash.slots.tolist()):
            self.at[slot] = i
        ids = {t: i for i, t in enumerate(tokens)}
        self.byte = [ids[bytes([b])] for b in range(256)]
        #: (left id, right id) as one number -> the id of both together: every way to cut a token in two tokens
        self.joined = {ids[a] << 20 | ids[b]: i for i, t in enumerate(tokens) for k in range(1, len(t)) if (a := t[:k]) in ids and (b := t[k:]) in ids}
        self._ready()

    def _ready(self) -> None:
        self.names = list(map(str, range(len(self.tokens))))
        self.split = splitter(self.pattern)
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "names", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.byte[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joined, pop, push = self.joined.get, heapq.heappop, heapq.heappush
        bits = n.bit_length()
        places = (1 << bits) - 1
        #: rank of the pair that begins at each place; a heap entry is the rank and the place, void once the rank is another
        ranks = [joined(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
        ranks.append(-1)
        heap = [rank << bits | i for i, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i, rank = entry & places, entry >> bits
            if ranks[i] != rank:
                continue
            j = after[i]
            ids[i] = rank
            ids[j] = ranks[j] = -1
            k = after[i] = after[j]
            ranks[i] = -1
            if k < n:
                before[k] = i
                ranks[i] = found = joined(rank << 20 | ids[k], -1)
                if found >= 0:
                    push(heap, found << bits | i)
            h = before[i]
            if h >= 0:
                ranks[h] = found = joined(ids[h] << 20 | rank, -1)
                if found >= 0:
                    push(heap, found << bits | h)
        return tuple([x for x in ids if x >= 0])

    def _resolved(self, pieces: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """The ids of distinct pre-tokens: the perfect hash first, the heap for its misses."""
        raw = [p.encode() for p in pieces]
        for piece, token, slot in zip(pieces, raw, self.hash.find(raw)):
            i = self.at[slot]
            yield piece, (i,) if self.tokens[i] == token else self.merged(token)

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in set(pieces) if p not in self.known]
        if not new:
            return list(chain.from_iterable(map(self.known.__getitem__, pieces)))
        short = [p for p in new if len(p) <= REMEMBERED_LENGTH]
        self.known.update(self._resolved(short))
        if len(short) == len(new):
            return list(chain.from_iterable(map(self.known.__getitem__, pieces)))
        long = dict(self._resolved([p for p in new if len(p) > REMEMBERED_LENGTH]))
        return list(chain.from_iterable(long[p] if p in long else self.known[p] for p in pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def spelled(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def default_codec(path: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def encode_texts(docs: DataFrame, codec: Codec) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, ids: array<int>, decoded: binary). Null counts as an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # the size of the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            ids = [codec.encode(x.decode()) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, ids array<int>, decoded binary")


def round_trips(docs: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row per row: digests of what encode_texts() returns.

    Null and empty texts have no tokens. Repeated rows come out repeatedly, an empty table gives none, other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            counts, spelled, decoded = [], [], []
            for text in as_bytes(batch.column(1)):
                ids = codec.encode(text.decode())
                counts.append(len(ids))
                spelled.append(hashlib.sha256(codec.spelled(ids).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
