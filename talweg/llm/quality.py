"""Quality classifier: gated-attention multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import as_bytes, fold, labelled_sample, map_arrow

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Words of a passage; the last one of a text may be shorter.
PASSAGE = 64
#: Documents that train the model at most, and passages of one of them; of more passages, evenly spaced ones train.
TRAINING_ROWS = 3000
TRAINING_PASSAGES = 64
HIDDEN = 16
ATTENTION = 8
STEPS = 250
#: Numbers that hold the byte triples of a passage's words.
HASHED = 32

#: Byte classes that are counted.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"|", b"#*$%&<>", b"'\"()[]{}-_/\\", bytes(range(128, 256)))
CLASS_OF = np.zeros(256, np.int64)
for _i, _bytes in enumerate(CLASSES):
    CLASS_OF[list(_bytes)] = _i + 1
WIDTH = len(CLASSES) + 1
FEATURES = len(CLASSES) + 4 + HASHED


def hashed_triples(words: list[bytes], lengths: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """The byte triples of each passage's words in lower case, blanks between them, hashed with a sign; over the root of their number."""
    data = np.frombuffer(b" " + b" ".join(words).lower() + b" ", np.uint8).astype(np.uint32)
    triples = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    cells = (triples * np.uint32(0x9E3779B1)) >> np.uint32(16)
    owner = np.repeat(of, lengths + 1)[: len(cells)]
    counts = np.bincount(owner * (2 * HASHED) + cells % np.uint32(2 * HASHED), minlength=count * 2 * HASHED).reshape(count, 2, HASHED)
    return (counts[:, 0] - counts[:, 1]) / np.sqrt(counts.sum(axis=(1, 2)))[:, None]


def passages(text: bytes) -> np.ndarray:
    """One row of features for each passage of a whole text; a text without words is one passage of zeros.

    Shares of the byte classes, length of words, share of words in repeated windows of three (over the whole text), share
    of distinct words, how full the passage is, and its words' hashed byte triples.
    """
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    of = np.arange(n) // PASSAGE
    count = int(of[-1]) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    data = np.frombuffer(b"".join(words), np.uint8)
    classes = np.bincount(np.repeat(of, lengths) * WIDTH + CLASS_OF[data], minlength=count * WIDTH).reshape(count, WIDTH)[:, 1:]
    chars = np.bincount(of, weights=lengths, minlength=count)
    size = np.bincount(of, minlength=count)
    hashes = np.fromiter(map(hash, words), np.int64, n)
    distinct = np.bincount(np.unique(of * np.int64(1 << 40) + (hashes & ((1 << 40) - 1))) >> 40, minlength=count)
    repeated = np.zeros(n)
    if n >= 3:
        grams = hashes[:-2] * np.int64(31) + hashes[1:-1] * np.int64(1_000_003) + hashes[2:] * np.int64(998_244_353)
        _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
        twice = (times > 1)[at]
        repeated[:-2] = twice
        repeated[1:-1] = np.maximum(repeated[1:-1], twice)
        repeated[2:] = np.maximum(repeated[2:], twice)
    own = (np.log1p(chars / size) / 3, np.bincount(of, weights=repeated, minlength=count) / size, distinct / size, np.log1p(size) / np.log(PASSAGE + 1))
    return np.column_stack([np.sqrt(classes / chars[:, None]), *own, hashed_triples(words, lengths, of, count)]).astype(np.float32)


class AttentionModel:
    """h = tanh(Wx + b); weights softmax(w . (tanh(Vh) * sigmoid(Uh))); score sigmoid(c . sum(weight * h) + d)."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.4, shape)
        self.p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """x: passages of all documents, one after the other; starts: where each document begins."""
        p = self.p
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        logit = z @ p["c"] + p["d"][0]
        return {"sizes": sizes, "h": h, "t": t, "s": s, "weight": weight, "z": z, "logit": logit}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, decay: float = 1e-4) -> "AttentionModel":
        """Adam on the log loss of the documents' labels, all documents in each step."""
        x = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        starts = np.cumsum([0, *map(len, bags[:-1])])
        self.p["d"][0] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for step in range(1, steps + 1):
            p = self.p
            for k, g in self.gradients(x, starts, labels).items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = p[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by every parameter."""
        f, p = self._forward(x, starts), self.p
        d_logit = (1 / (1 + np.exp(-f["logit"])) - labels) / len(labels)
        d_z = np.repeat(d_logit, f["sizes"])[:, None] * p["c"]
        along = (d_z * f["h"]).sum(axis=1)
        mean = np.add.reduceat(f["weight"] * along, starts)
        d_a = f["weight"] * (along - np.repeat(mean, f["sizes"]))
        d_t, d_s = d_a[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), d_a[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        d_h = (f["weight"][:, None] * d_z + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ d_h, "b": d_h.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_s, "w": (f["t"] * f["s"]).T @ d_a, "c": f["z"].T @ d_logit, "d": d_logit.sum(keepdims=True)}

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents, and the attention weights of all their passages."""
        x = (np.concatenate(bags) - self.mean) / self.scale
        f = self._forward(x, np.cumsum([0, *map(len, bags[:-1])]))
        return 1 / (1 + np.exp(-f["logit"])), f["weight"]


def thinned(bag: np.ndarray) -> np.ndarray:
    """Evenly spaced passages of a long text, which bounds what training collects."""
    return bag if len(bag) <= TRAINING_PASSAGES else bag[np.linspace(0, len(bag) - 1, TRAINING_PASSAGES).round().astype(int)]


def train(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """Learns from a bounded sample of labelled documents outside the held-out fold; without any, scores are near one half."""
    sample = labelled_sample(docs, labels, "quality", folds=FOLDS, held=HELD_OUT, rows=TRAINING_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [thinned(passages(x)).tobytes() for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary()), batch.column(2)], ["doc_id", "bag", "y"])

    rows = sorted((r.doc_id, bytes(r.bag), r.y) for r in map_arrow(sample.select(F.col("doc_id").cast("bigint"), "text", "y"), run, "doc_id bigint, bag binary, y int").collect())
    model = AttentionModel()
    if rows:
        model.fit([np.frombuffer(bag, np.float32).reshape(-1, FEATURES) for _, bag, _ in rows], np.array([y for *_, y in rows], float))
    return model


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, score, n_passages, top_passage, top_weight), a row per row.

    Every passage of the whole text counts; null and empty texts are one empty passage. top_passage is the number
    of the passage with most attention. Repeated rows come out repeatedly, an empty table gives none, other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bags = [passages(x) for x in as_bytes(batch.column(1))]
            scores, weights = model.score(bags)
            ends = np.cumsum(list(map(len, bags)))
            parts = np.split(weights, ends[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(map(len, bags), pa.int32()), pa.array([int(w.argmax()) for w in parts], pa.int32()), pa.array([float(w.max()) for w in parts])], ["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double, n_passages int, top_passage int, top_weight double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores by a model trained on labels, with the fold of each document and the predicted label."""
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "top_passage", "top_weight")
