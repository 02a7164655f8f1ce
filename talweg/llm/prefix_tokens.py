"""Token counts by prefix dynamic programming over a BPE with word ends.

The last token of a prefix's encoding decides it: t is the last token of the first i symbols exactly if t ends
at i and is compatible with the last token of the first i - len(t) symbols, and then the count there grows by
one. Two tokens are compatible if encoding both together leaves both as they are.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import as_bytes, map_arrow
from talweg.llm.pieces import spelled_out, splitter, tokenizers_classes

#: Pre-tokens, and pairs of tokens, that a worker remembers, and the characters that such a pre-token may have: bounds on its memory only.
REMEMBERED, REMEMBERED_LENGTH = 1 << 19, 64
NEVER = 1 << 60


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: its own where printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of a word-end BPE, at the ends of pre-tokens and at every prefix within them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.spec = json.dumps({k: spec[k] for k in ("version", "truncation", "padding", "post_processor", "decoder", "normalizer", "pre_tokenizer")} | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        self.pattern = spelled_out(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], tokenizers_classes())
        self.special = [t["content"] for t in spec["added_tokens"]]
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        #: (left id, right id) as one number -> rank of the merge
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            whole, a, b = self.ids[a + b], self.ids[a], self.ids[b]
            self.rank[a << 20 | b] = rank
            parts.setdefault(whole, (rank, a, b))
        #: from the outer symbol to the whole token: the tokens at its right and left edge, with the rank of the merge that ends each
        self.right_edge = {t: self._edge(t, parts, 2) for t in self.ids.values()}
        self.left_edge = {t: self._edge(t, parts, 1) for t in self.ids.values()}
        self._ready()

    @staticmethod
    def _edge(token: int, parts: dict[int, tuple[int, int, int]], side: int) -> tuple[tuple[int, int], ...]:
        steps, until = [], NEVER
        while True:
            steps.append((token, until))
            if token not in parts:
                return tuple(reversed(steps))
            until = parts[token][0]
            token = parts[token][side]

    def _ready(self) -> None:
        from tokenizers import Tokenizer

        self.letters = _byte_letters()
        self.split = splitter(self.pattern)
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.normalizer = Tokenizer.from_str(self.spec).normalizer
        self.counts: dict[str, int] = {}
        self.fitting: dict[int, bool] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("letters", "split", "specials", "normalizer", "counts", "fitting")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that complete both tokens.

        The tokens grow at the border in the order of their merges. At equal rank the leftmost merge is first: one
        inside the left token precedes the border's, which precedes one inside the right token.
        """
        key = left << 20 | right
        if (found := self.fitting.get(key)) is not None:
            return found
        if len(self.fitting) > REMEMBERED:
            self.fitting.clear()
        a, b = self.right_edge[left], self.left_edge[right]
        i = j = 0
        fits = None
        while fits is None:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = self.rank.get(x << 20 | y, NEVER)
            if across < x_until and across <= y_until and across != NEVER:
                fits = False
            elif x_until == y_until == NEVER:
                fits = True
            elif x_until <= y_until:
                i += 1
            else:
                j += 1
        self.fitting[key] = fits
        return fits

    def _open(self, word: str, upto: int) -> tuple[list[int], list[int]]:
        """For each prefix that doesn't end the word: its last token and its count."""
        last, count = [-1], [0]
        get, fitting, longest = self.ids.get, self.fitting, self.longest
        for i in range(1, upto + 1):
            for k in range(i - 1, max(0, i - longest) - 1, -1):
                t = get(word[k:i])
                if t is None:
                    continue
                if k == 0:
                    break
                fits = fitting.get(last[k] << 20 | t)
                if fits or fits is None and self.compatible(last[k], t):
                    break
            last.append(t)
            count.append(count[k] + 1)
        return last, count

    def _closed(self, word: str, i: int, last: list[int], count: list[int]) -> int:
        """Tokens of the first i symbols if they end the word."""
        for k in range(i - 1, max(0, i - self.longest) - 1, -1):
            t = self.ids.get(word[k:i] + self.end)
            if t is not None and (k == 0 or self.compatible(last[k], t)):
                return count[k] + 1
        raise ValueError(f"no encoding for {word!r}")

    def size(self, piece: str) -> int:
        """Tokens of a pre-token."""
        word = "".join(map(self.letters.__getitem__, piece.encode()))
        return self._closed(word, len(word), *self._open(word, len(word) - 1))

    def prefixes(self, piece: str) -> list[int]:
        """Tokens of each prefix of a pre-token, by number of its bytes, each prefix ending a word."""
        word = "".join(map(self.letters.__getitem__, piece.encode()))
        last, count = self._open(word, len(word) - 1)
        return [0, *(self._closed(word, i, last, count) for i in range(1, len(word) + 1))]

    def normal(self, text: str) -> str:
        """The library's normal form; ASCII is lowered here, its white space stays, as it is dropped later."""
        return text.lower() if text.isascii() else self.normalizer.normalize_str(text)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at the strings of special tokens, which count as one token each."""
        if self.specials is None or "<|" not in text:
            return [(text, False)]
        found, at = [], 0
        for m in self.specials.finditer(text):
            found += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [x for x in [*found, (text[at:], False)] if x[0]]

    def _each(self, pieces: list[str]) -> list[int]:
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        long = {}
        for piece in set(pieces):
            if piece not in self.counts:
                (self.counts if len(piece) <= REMEMBERED_LENGTH else long)[piece] = self.size(piece)
        return [long[p] if p in long else self.counts[p] for p in pieces] if long else list(map(self.counts.__getitem__, pieces))

    def table(self, text: str) -> "PrefixTable":
        """The counts at every prefix of a whole text."""
        pieces: list[str] = []
        counts: list[int] = []
        for part, special in self.segments(text):
            own = [part] if special else self.split(self.normal(part))
            pieces += own
            counts += [1] if special else self._each(own)
        return PrefixTable(self, pieces, list(accumulate(counts, initial=0)))

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return self.table(text).total()


class PrefixTable:
    """The counts of one text at each of its prefixes; no question encodes anything again."""

    def __init__(self, counter: PrefixCounter, pieces: list[str], totals: list[int]):
        self.counter, self.pieces, self.totals = counter, pieces, totals

    def total(self) -> int:
        return self.totals[-1]

    def after(self, pieces: int) -> int:
        """Tokens of the first so many pre-tokens."""
        return self.totals[min(pieces, len(self.pieces))]

    def truncate(self, budget: int) -> tuple[int, int]:
        """The longest run of whole leading pre-tokens within a token budget, and the tokens it takes."""
        n = bisect_right(self.totals, budget) - 1
        return n, self.totals[n]

    def within(self, budget: int) -> tuple[int, int]:
        """As truncate(), with the bytes of the next pre-token that still fit (it ends the word there)."""
        n, used = self.truncate(budget)
        if n == len(self.pieces) or self.pieces[n] in self.counter.special:
            return n, 0
        inside = self.counter.prefixes(self.pieces[n])
        return n, max(k for k, c in enumerate(inside) if used + c <= budget)


def default_counter(path: str | None = None) -> PrefixCounter:
    import public_tokenizers

    return PrefixCounter(path or public_tokenizers.path("word_bpe_49k.json"))


def token_counts(docs: DataFrame, counter: PrefixCounter, limit: int = 2048) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_bytes, n_tokens, over_limit, n_within), a row per row.

    The text's prefix table answers all of it: its last count, and where the limit falls in it. n_within: tokens of
    the longest run of whole leading pre-tokens within the limit. Null and empty texts have no bytes and no tokens. Repeated rows come out repeatedly, an empty table gives
    none, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counter)  # the size of the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            raw = as_bytes(batch.column(1))
            totals, over, within = [], [], []
            for x in raw:
                table = counter.table(x.decode())
                pieces, used = table.truncate(limit)
                totals.append(table.total())
                over.append(pieces < len(table.pieces))
                within.append(used)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(totals, pa.int64()), pa.array(over, pa.bool_()), pa.array(within, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_within"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_within bigint")
