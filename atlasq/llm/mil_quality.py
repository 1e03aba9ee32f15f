"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words; all of them are encoded. A passage's features go through one tanh layer;
a gated attention (tanh times sigmoid of that layer) weighs the passages of a bag, and a logistic output scores the
weighted sum. Only bags have labels. Features come from byte classes, word shapes, repeats within the text and hashed
words, computed for whole slices of texts at once.

The model is fitted on the driver to the features of at most SAMPLE labelled training texts, those of the lowest hash:
the documented bound. Scoring covers every passage of every text.

Defined results: a null, empty or wordless text is a bag of one empty passage and has a score as well; without labels of
both kinds every score is the share of ones (0.5 without any); of several labels of a document the mean decides, one half
counting as 1; repeated rows are scored each; an empty table gives an empty table; input columns are kept, but one named
like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACED, Words, besides, crc_bucket, slices, splitmix

#: Words in a passage, labelled texts that are learned from at most, hashed word features.
PASSAGE, SAMPLE, HASHED = 64, 5000, 24
#: Units of the encoder and of the attention, steps of gradient descent, its rate, and the weight decay.
ENCODED, ATTENTION, STEPS, RATE, DECAY = 16, 8, 200, 0.03, 1e-4
#: From this score on the predicted label is 1.
LEAST_SCORE = 0.3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b".,;:", b"!?", b"@/\\_=+~^\"'()[]{}", bytes(range(128, 256))]
_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _members in enumerate(_CLASSES):
    _OF[list(_members)] = _k
N_FEATURES = len(_CLASSES) + 9 + HASHED


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and the row at which each text begins (and the number of rows)."""
    words = Words(texts, SPACED)
    bounds = words.bounds()
    n_words = np.diff(bounds)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    begins = np.append(0, np.cumsum(n_passages))
    out = np.zeros((begins[-1], N_FEATURES))
    if not len(words.start):
        return out, begins
    in_text = np.arange(len(words.start)) - np.repeat(bounds[:-1], n_words)
    passage = begins[words.doc] + in_text // PASSAGE
    first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    rows = passage[first]

    def total(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), first)

    length = words.end - words.start
    count, chars = total(np.ones(len(length))), total(length)
    kinds = _OF[words.data]
    share = {}
    for k in range(len(_CLASSES)):
        sums = np.append(0, np.cumsum(kinds == k))
        share[k] = sums[words.end] - sums[words.start]
        out[rows, k] = total(share[k]) / chars
    m = len(_CLASSES)
    out[rows, m] = count / PASSAGE
    out[rows, m + 1] = chars / count / 10
    out[rows, m + 2] = total(share[0] * 2 > length) / count
    out[rows, m + 3] = total((share[0] + share[1] + share[2] + share[7]) == 0) / count
    out[rows, m + 4] = total(share[5] > 0) / count
    out[rows, m + 5] = total(share[3] > 0) / count
    pairs = splitmix(words.hash + passage.astype(np.uint64))
    _, one, times = np.unique(pairs, return_index=True, return_counts=True)
    distinct = np.bincount(passage[one], minlength=len(out))
    out[rows, m + 6] = distinct[rows] / count
    begin = np.flatnonzero(words.doc[2:] == words.doc[:-2])  # triples within one text; neighbours in the slice count for nothing
    triple = splitmix(words.hash[begin] + splitmix(words.hash[begin + 1] + splitmix(words.hash[begin + 2] + words.doc[begin].astype(np.uint64))))
    _, at, times = np.unique(triple, return_inverse=True, return_counts=True)
    again = np.zeros(len(length))
    again[begin] = times[at] > 1
    out[rows, m + 7] = total(again) / count
    breaks = np.append(0, np.cumsum(words.data == 10))
    out[rows, m + 8] = (breaks[words.end[np.append(first[1:], len(length)) - 1]] - breaks[words.start[first]]) / count
    slot = (words.hash % np.uint64(HASHED)).astype(np.int64)
    sign = np.where(words.hash >> np.uint64(63), 1.0, -1.0)
    hashed = np.bincount(passage * HASHED + slot, sign, len(out) * HASHED).reshape(-1, HASHED)
    out[:, m + 9 :] = hashed / np.sqrt(np.maximum(1, out[:, m] * PASSAGE))[:, None]
    return out, begins


class Model:
    """Scaling of features, encoder, gated attention and output."""

    def __init__(self, constant: float | None = None) -> None:
        self.constant, self.weights = constant, {}

    def fit(self, x: np.ndarray, begins: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
        """Adam on the mean cross entropy of all bags."""
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        shapes = {"we": (x.shape[1], ENCODED), "be": (ENCODED,), "wt": (ENCODED, ATTENTION), "wg": (ENCODED, ATTENTION), "wa": (ATTENTION,), "wo": (ENCODED,), "bo": ()}
        self.weights = {k: np.asarray(rng.normal(0, 1 / np.sqrt(s[0]) if s else 0.0, s) if k[0] == "w" else np.zeros(s)) for k, s in shapes.items()}
        moment, square = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}
        x = self.scaled(x)
        for t in range(1, STEPS + 1):
            for k, g in self.gradient(x, begins, y).items():
                g = g + DECAY * self.weights[k] * (k[0] == "w")
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                self.weights[k] = self.weights[k] - RATE * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def _forward(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        p, starts, sizes = self.weights, begins[:-1], np.diff(begins)
        h = np.tanh(x @ p["we"] + p["be"])
        t, g = np.tanh(h @ p["wt"]), 1 / (1 + np.exp(-(h @ p["wg"])))
        logit = (t * g) @ p["wa"]
        weight = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), sizes))
        weight /= np.repeat(np.add.reduceat(weight, starts), sizes)
        bag = np.add.reduceat(h * weight[:, None], starts, axis=0)
        return h, t, g, weight, bag, 1 / (1 + np.exp(-np.clip(bag @ p["wo"] + p["bo"], -40, 40)))

    def gradient(self, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        p, sizes = self.weights, np.diff(begins)
        h, t, g, weight, bag, score = self._forward(x, begins)
        d_out = (score - y) / len(y)
        d_bag = np.repeat(d_out[:, None] * p["wo"], sizes, axis=0)
        pull = (d_bag * h).sum(axis=1)
        d_logit = weight * (pull - np.repeat(np.add.reduceat(weight * pull, begins[:-1]), sizes))
        d_t, d_g = d_logit[:, None] * p["wa"] * g * (1 - t * t), d_logit[:, None] * p["wa"] * t * g * (1 - g)
        d_h = (d_bag * weight[:, None] + d_t @ p["wt"].T + d_g @ p["wg"].T) * (1 - h * h)
        return {"we": x.T @ d_h, "be": d_h.sum(axis=0), "wt": h.T @ d_t, "wg": h.T @ d_g, "wa": (t * g).T @ d_logit, "wo": bag.T @ d_out, "bo": d_out.sum()}

    def score(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each bag, and the attention weight of each passage."""
        if self.constant is not None:
            return np.full(len(begins) - 1, self.constant), np.ones(len(x))
        *_, weight, _, score = self._forward(self.scaled(x), begins)
        return score, weight


def sample_of(docs: DataFrame, labels: DataFrame, train: Column, key_col: str, label_col: str, text_col: str = "text", size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, begins and labels of at most ``size`` labelled training texts; only features come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(key_col).isNotNull()).select(F.col(key_col).alias("key"), F.col(label_col).alias("y"))
    known = known.groupBy("key").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    chosen = known.where(train).orderBy(F.xxhash64("key"), "key").limit(size)
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key").select("key", "y", "text")  # at most ``size`` rows are broadcast

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in slices(batch.column(2)):
                x, begins = features(texts)
                blobs = [x[a:b].astype(np.float32).tobytes() for a, b in zip(begins, begins[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), batch.column(1).slice(i, len(texts)), pa.array(blobs, pa.binary())], names=["key", "y", "x"])

    kind = docs.schema[key_col].dataType.simpleString()
    got = sorted(rows.mapInArrow(step, f"key {kind}, y double, x binary").collect(), key=lambda r: (r["key"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in got]
    begins = np.append(0, np.cumsum([len(b) for b in bags])).astype(np.int64)
    return np.concatenate([np.zeros((0, N_FEATURES)), *bags]), begins, np.array([r["y"] for r in got])


def fitted(x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> Model:
    """A model of the sample, or a constant where it has labels of one kind or none."""
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    return Model().fit(x, begins, y)


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with score and attention, the weight of each passage."""
    kept = besides(docs.columns if keep is None else keep, ("score", "attention"))
    at, kept_at = docs.columns.index(text_col), [docs.columns.index(c) for c in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in slices(batch.column(at)):
                part = batch.slice(i, len(texts))
                x, begins = features(texts)
                score, weight = shared.value.score(x, begins)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept_at), pa.array(score), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(weight))], names=[*kept, "score", "attention"])

    shape = ", ".join([*(f"`{docs.columns[k]}` {docs.schema[k].dataType.simpleString()}" for k in kept_at), "score double, attention array<double>"])
    return docs.mapInArrow(step, shape)


def op9_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of query op9 over documents and labels."""
    model = fitted(*sample_of(docs, labels, crc_bucket(F.col("key"), 5) != 0, "doc_id", "quality"))
    rows = docs.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    out = scored(rows, model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
