"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give spans and document scores."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import as_bytes, fold, labelled_sample, map_arrow, spread

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Tokens with this marginal are in a span.
IN_SPAN = 0.5
#: Documents that train the field at most, and characters of one of them; of longer texts, slices from all over them train.
TRAINING_ROWS = 5000
TRAINING_CHARS = 12_000
#: Tokens of a training sequence, and of sequences together, beyond which those without labelled tokens are thinned.
WINDOW = 24
TRAINING_TOKENS = 72_000
#: Training sequences whose marginals are computed at once, which bounds the memory and nothing else.
BLOCK = 2048
#: A feature marks a token of a toxic document as toxic if this part of the groups of near-copies that have it is toxic, and
#: if as many toxic ones, with as many features tried, would come by chance this rarely.
LEAST_TOXIC = 0.9
CHANCE = 0.05
PREFIXES = (3, 4, 5, 6)
STEPS = 80
#: Minimum hashes of a training document; those that share one are near-copies.
SKETCH = 3
REMEMBERED = 1 << 18
#: Powers of the step matrix that are at hand.
NEAR = 512

TOKEN = re.compile(r"\w+")


def features(token: str) -> list[str]:
    """The token in lower case, and its beginnings."""
    low = token.lower()
    return ["=" + low, *(low[:k] for k in PREFIXES if len(low) >= k)]


class Field:
    """Two states, clean and toxic. Weights: of features for toxic, of pairs of states, and of the first state."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias = -4.0
        self.pairs = np.zeros((2, 2))
        self.scale, self.shift = 1.0, 0.0
        self._ready()

    def _ready(self) -> None:
        self.known: dict[str, float] = {}
        #: The first letters of everything that has a weight: most tokens begin otherwise, and have no evidence.
        self.openings = {f.removeprefix("=")[: PREFIXES[0]] for f in self.weights}
        # between tokens without features the states move by one matrix; its powers follow from its eigenvalues
        self.step = np.exp(self.pairs) * np.array([1.0, math.exp(self.bias)])
        values, vectors = np.linalg.eig(self.step)
        order = np.argsort(-values.real)
        self.ratio = float(values.real[order[1]] / values.real[order[0]])
        vectors = vectors.real[:, order]
        inverse = np.linalg.inv(vectors)
        self.lasting, self.fading = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])
        self.powers = [self._power(k) for k in range(NEAR)]

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("weights", "bias", "pairs", "scale", "shift")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    # training

    def fit(self, windows: list[tuple[list[str], list[int]]]) -> "Field":
        """Proximal Adam on the log likelihood of labelled token sequences; the penalty leaves most weights at zero."""
        seen = Counter(f for tokens, tags in windows for t, y in zip(tokens, tags) if y for f in set(features(t)))
        names = sorted(f for f, n in seen.items() if n >= 2)  # features of no toxic token are left to the bias
        index = {f: i for i, f in enumerate(names)}
        long = max(len(t) for t, _ in windows)
        labels, there = np.zeros((len(windows), long), np.int8), np.zeros((len(windows), long), bool)
        at, of = array("q"), array("q")  # the places of the known features, row by row, and these features
        for s, (tokens, tags) in enumerate(windows):
            there[s, : len(tokens)] = True
            labels[s, : len(tags)] = tags
            for t, token in enumerate(tokens):
                own = [index[f] for f in features(token) if f in index]
                at.extend([s * long + t] * len(own))
                of.extend(own)
        at, of = np.array(at, np.int64), np.array(of, np.int64)
        cuts = range(0, len(windows), BLOCK)
        edges = np.searchsorted(at, [c * long for c in cuts] + [len(windows) * long])
        theta, bias, pairs = np.zeros(len(names)), np.array([self.bias]), np.zeros((2, 2))
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, bias, pairs)]
        count = there.sum()
        follows = there[:, 1:]
        pair_labels = np.bincount((labels[:, :-1] * 2 + labels[:, 1:])[follows], minlength=4).reshape(2, 2)
        for step in range(1, STEPS + 1):
            d_theta, d_bias, pair_sums = np.zeros_like(theta), 0.0, np.zeros((2, 2))
            for k, cut in enumerate(cuts):
                some, place, feature = there[cut : cut + BLOCK], at[edges[k] : edges[k + 1]] - cut * long, of[edges[k] : edges[k + 1]]
                e = np.bincount(place, weights=theta[feature], minlength=some.size).reshape(some.shape)
                marginals, sums = self._marginals(np.where(some, e + bias[0], 0.0), some, pairs)
                d_e = np.where(some, marginals - labels[cut : cut + BLOCK], 0.0)
                d_theta += np.bincount(feature, weights=d_e.ravel()[place], minlength=len(theta))
                d_bias += d_e.sum()
                pair_sums += sums
            grads = (d_theta, np.array([d_bias]), pair_sums - pair_labels + 0.5 * pairs)
            for x, g, mom in zip((theta, bias, pairs), grads, moments):
                mom[0] = 0.9 * mom[0] + 0.1 * g
                mom[1] = 0.999 * mom[1] + 0.001 * g * g
                x -= 0.15 * (mom[0] / (1 - 0.9**step)) / (np.sqrt(mom[1] / (1 - 0.999**step)) + 1e-8)
            theta[np.abs(d_theta) < 1e-6 * count] *= 0.98
            theta[:] = np.sign(theta) * np.maximum(np.abs(theta) - 0.01, 0)
        self.weights = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 0.05}
        self.bias, self.pairs = float(bias[0]), pairs
        self._ready()
        return self

    @staticmethod
    def _marginals(e: np.ndarray, there: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over many padded sequences: P(toxic) of each token, expected counts of state pairs."""
        n, long = e.shape
        move = np.exp(pairs)
        emit = np.stack((np.ones_like(e), np.exp(np.clip(e, -30, 30))), axis=2)
        ahead, back = np.zeros((n, long, 2)), np.ones((n, long, 2))
        ahead[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, long):
            x = (ahead[:, t - 1] @ move) * emit[:, t]
            ahead[:, t] = np.where(there[:, t, None], x / x.sum(axis=1, keepdims=True), ahead[:, t - 1])
        expected = np.zeros((2, 2))
        for t in range(long - 2, -1, -1):
            y = emit[:, t + 1] * back[:, t + 1]
            x = y @ move.T
            back[:, t] = np.where(there[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
            joint = ahead[:, t, :, None] * move[None] * y[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += joint[there[:, t + 1]].sum(axis=0)
        both = ahead * back
        return both[:, :, 1] / both.sum(axis=2), expected

    # tagging

    def evidence(self, token: str) -> float:
        """What a token's features say for toxic; zero for most."""
        if token.lower()[: PREFIXES[0]] not in self.openings:
            return 0.0
        return sum(self.weights.get(f, 0.0) for f in features(token))

    def _power(self, k: int) -> tuple[float, float, float, float]:
        """The k-th power of the step matrix over that of its larger eigenvalue, row by row."""
        return tuple((self.lasting + self.ratio**k * self.fading).ravel().tolist())

    def marginals(self, n: int, places: list[int], evidence: list[float]) -> list[float]:
        """P(toxic) at places of a sequence of n tokens, all those with evidence among them.

        Exact forward-backward: a run of k tokens without evidence is one multiplication by the k-th power.
        """
        near, exp = self.powers, math.exp
        gaps = [b - a for a, b in zip([0, *places], [*places, n - 1])]
        steps = [near[k] if k < NEAR else self._power(k) for k in gaps]
        gains = [exp(max(-30.0, min(30.0, x))) for x in evidence]
        clean, toxic = 1.0, exp(self.bias)  # the first token's states, without evidence
        ahead = []
        for (cc, ct, tc, tt), gain in zip(steps, gains):
            clean, toxic = clean * cc + toxic * tc, (clean * ct + toxic * tt) * gain
            total = clean + toxic
            clean, toxic = clean / total, toxic / total
            ahead.append((clean, toxic))
        cc, ct, tc, tt = steps.pop()
        clean, toxic = cc + ct, tc + tt  # from here on, what follows each state
        out = []
        for (a, b), gain, (cc, ct, tc, tt) in zip(reversed(ahead), reversed(gains), reversed(steps)):
            x, y = a * clean, b * toxic
            out.append(y / (x + y))
            toxic *= gain
            clean, toxic = cc * clean + ct * toxic, tc * clean + tt * toxic
            total = clean + toxic
            clean, toxic = clean / total, toxic / total
        return out[::-1]

    def tag(self, text: str) -> tuple[float, list[int], list[float]]:
        """The largest marginal of a text's tokens, and places and marginals: of the tokens with evidence, and of all tokens around
        those inside a span, until the spans end among them."""
        tokens = TOKEN.findall(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for t in set(tokens).difference(known):
            known[t] = self.evidence(t)
        values = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        places = np.flatnonzero(values)
        rest = float(self.lasting[1, 1])  # P(toxic) far from any evidence
        if not len(places):
            return (rest if tokens else 0.0), [], []
        reach = 1
        while True:
            found = self.marginals(len(tokens), places.tolist(), values[places].tolist())
            inside = places[np.array(found) >= IN_SPAN]
            around = (inside[:, None] + np.arange(-reach, reach + 1)).ravel()
            wider = np.union1d(places, around[(around >= 0) & (around < len(tokens))])
            if len(wider) == len(places) or not len(inside):
                return max(rest, max(found)), places.tolist(), found
            places, reach = wider, 2 * reach

    def score(self, largest: float) -> float:
        """The document's score: its largest marginal, calibrated on the labels of the training documents."""
        x = min(max(largest, 1e-9), 1 - 1e-9)
        return 1 / (1 + math.exp(-(self.scale * math.log(x / (1 - x)) + self.shift)))

    def spans(self, text: str, places: list[int], marginals: list[float]) -> list[dict]:
        """Runs of neighbouring tokens with a marginal of one half or more, as character offsets."""
        chosen = {p: m for p, m in zip(places, marginals) if m >= IN_SPAN}
        found: list[dict] = []
        if chosen:
            before = -2
            for i, match in enumerate(TOKEN.finditer(text)):
                if i in chosen:
                    if before == i - 1:
                        found[-1]["end"] = match.end()
                        found[-1]["p"] = max(found[-1]["p"], chosen[i])
                    else:
                        found.append({"start": match.start(), "end": match.end(), "p": chosen[i]})
                    before = i
        return found


def copy_groups(texts: list[list[str]]) -> list[int]:
    """A number for each text; texts that share a minimum hash of their word triples share the number."""
    mixers = np.random.default_rng(8).integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
    owner: dict[tuple[int, int], int] = {}
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, tokens in enumerate(texts):
        triples = {" ".join(t) for t in zip(tokens, tokens[1:], tokens[2:])} or {" ".join(tokens)}
        hashes = np.array([xxhash.xxh64_intdigest(t) for t in triples], np.uint64)
        for k, mixer in enumerate(mixers):
            low = int((hashes * mixer).min())
            root[find(i)] = find(owner.setdefault((k, low), i))
    return [find(i) for i in range(len(texts))]


def token_labels(texts: list[list[str]], toxic: list[int]) -> list[list[int]]:
    """Labels of tokens from labels of documents: tokens of toxic documents that have a feature of toxic documents only.

    A group of near-copies counts once, else every rare word of a toxic text that was copied would seem a sign.
    """
    groups = copy_groups(texts)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    sizes = [0, 0]
    order = sorted(range(len(texts)), key=lambda i: (toxic[i], groups[i]))
    for (y, _), own in groupby(order, key=lambda i: (toxic[i], groups[i])):  # one group's features at a time
        seen[y].update({f for i in own for t in set(texts[i]) for f in features(t)})
        sizes[y] += 1
    share = sizes[1] / sum(sizes)
    tried = len(seen[0]) + sum(f not in seen[0] for f in seen[1])
    enough = math.log(tried / CHANCE)  # for all features together

    def telling(n: int, of: int) -> bool:
        """Chernoff's bound on n or more toxic groups among so many, were the feature no sign."""
        part = n / of
        gain = n * math.log(part / share) + (of - n) * math.log((1 - part) / (1 - share) if n < of else 1)
        return part >= max(LEAST_TOXIC, share) and gain >= enough

    marks = {f for f, n in seen[1].items() if telling(n, n + seen[0][f])} if share < 1 else set()
    signs = {t for t in set().union(*(x for x, y in zip(texts, toxic) if y)) if not marks.isdisjoint(features(t))}
    return [[int(t in signs) for t in tokens] if y else [0] * len(tokens) for tokens, y in zip(texts, toxic)]


def windows(texts: list[list[str]], tags: list[list[int]]) -> list[tuple[list[str], list[int]]]:
    """Training sequences: every one with labelled tokens, however many, and evenly spaced ones of the others.

    The others fill up to the bound, and are half of the bound at least, if there are so many.
    """
    near, far = [], []
    for tokens, own in zip(texts, tags):
        for at in range(0, len(tokens), WINDOW):
            part = (tokens[at : at + WINDOW], own[at : at + WINDOW])
            (near if any(part[1]) else far).append(part)
    bound = TRAINING_TOKENS // WINDOW
    room = max(bound - len(near), bound // 2)
    return near + far[:: max(1, -(-len(far) // room))]


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Learns from a bounded sample of labelled documents outside the held-out fold; without any, scores are low."""
    sample = labelled_sample(docs, labels, "toxic", folds=FOLDS, held=HELD_OUT, rows=TRAINING_ROWS)
    cut = sample.select(F.col("doc_id").cast("bigint"), spread(F.col("text"), F.col("doc_id"), TRAINING_CHARS).alias("t"), "y", (F.length("text") <= TRAINING_CHARS).alias("whole"))
    rows = sorted((r.doc_id, r.t, r.y, r.whole) for r in cut.collect())
    field = Field()
    toxic = [y for *_, y, _ in rows]
    if not any(toxic):
        return field
    texts = [TOKEN.findall(r[1]) for r in rows]
    chosen = windows(texts, token_labels(texts, toxic))
    if not chosen:
        return field
    field.fit(chosen)
    whole = [r for r in rows if r[3]] or rows  # a slice may lack the words that its text is labelled for
    calibrate(field, [field.tag(r[1])[0] for r in whole], [r[2] for r in whole])
    return field


def calibrate(field: Field, largest: list[float], toxic: list[int]) -> None:
    """Logistic regression of the documents' labels on the logit of their largest marginal, by Newton steps."""
    x = np.clip(np.array(largest), 1e-9, 1 - 1e-9)
    x = np.column_stack((np.log(x / (1 - x)), np.ones(len(x))))
    y = np.array(toxic, float)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * w), -2, 2)
    field.scale, field.shift = float(max(w[0], 0.01)), float(w[1])


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, score, spans), a row per row; spans: start, end and marginal.

    Every token of the whole text counts. Null and empty texts have no tokens and the lowest score. Repeated
    rows come out repeatedly, an empty table gives none, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for raw in as_bytes(batch.column(1)):
                text = raw.decode()
                largest, places, marginals = field.tag(text)
                scores.append(field.score(largest))
                spans.append(field.spans(text, places, marginals))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double, spans array<struct<start:int,end:int,p:double>>")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores by a field trained on labels, with the fold of each document, the predicted label and the spans as JSON."""
    rows = tag(docs, train(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; all columns stay. The verdict is made row by row, without a join.

    Null and empty texts have no tokens and stay. Rows without an id are judged like others, repeated rows share their
    verdict, an empty table gives no rows.
    """
    field = train(docs, labels)

    @F.pandas_udf("double")
    def largest(texts):
        return texts.map(lambda t: field.score(field.tag(t or "")[0]))

    return docs.filter(largest(docs["text"]) < THRESHOLD)
