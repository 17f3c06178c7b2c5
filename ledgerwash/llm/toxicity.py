"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features of a text are the distinct hash buckets of its words, word pairs, and
pairs with one word skipped. Training reads a bounded, deterministic sample of
the labelled rows (``per_class`` of each label, by hash of the id) in one task, as a
sorted stream of ``epochs`` passes, of which it holds a batch;
the bias is then corrected by the labels' sampling rates, so that scores follow
the labels' true shares whatever the size of the table. Per-coordinate learning rates and an L1 penalty leave few weights that are not
zero, so the model is a short list that goes to every executor. Scoring reads
whole texts and all rows.

Defined results: null text counts as empty; an empty text scores by the bias
alone; a null label trains nothing; an id labelled twice is toxic if any row
says so; labelled ids that occur in several rows train once, on the smallest
feature list; a null id is held out. Without any training row of both labels
every score is 0.0. Other columns never reach the model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwash.llm.memo import Memo, forgetful

BITS = 20
PER_CLASS = 8_000
EPOCHS = 4
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR, _SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_WORDS = 60_000  # remembered by a task


class Hasher:
    """Buckets of whole texts; keeps the hashes of words it has met (bounded)."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.known = Memo(xxhash.xxh64_intdigest, _WORDS)

    def _words(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        self.known.trim()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def buckets(self, text: str) -> np.ndarray:
        """Bucket of each word, pair and skip pair, with repeats."""
        h = self._words(text)
        grams = np.concatenate([h, h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + (h[2:] ^ _PAIR)])
        grams ^= grams >> np.uint64(31)
        return ((grams * _MIX) >> self.shift).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Weights that are not zero, by bucket, and the bias. ``known`` is false if
    there was nothing to learn from."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int
    known: bool = True

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.bucket] = self.weight
        return out

    def score(self, buckets: np.ndarray, dense: np.ndarray) -> float:
        if not self.known:
            return 0.0
        hit = buckets[dense[buckets] != 0]
        z = self.bias + dense[np.unique(hit)].sum()
        return 1 / (1 + math.exp(-z)) if z >= 0 else 1 - 1 / (1 + math.exp(z))


class Ftrl:
    """FTRL-proximal, fed row by row; the last coordinate is the bias, which has no
    penalty."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.bits, self.size = bits, 1 << bits
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        zi, penalty = self.z[i], np.where(i == self.size, 0.0, self.l1)
        w = -(zi - np.sign(zi) * penalty) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(zi) <= penalty, 0.0, w)

    def step(self, label: int, buckets: np.ndarray) -> None:
        i = np.append(buckets, self.size)
        w = self.weights(i)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        before = self.n[i]
        sigma = (np.sqrt(before + g * g) - np.sqrt(before)) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g

    def model(self) -> Model:
        final = self.weights(np.arange(self.size + 1))
        kept = np.flatnonzero(final[:self.size])
        return Model(kept.astype(np.int32), final[kept], float(final[self.size]), self.bits)


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text, mod 5, is 0; null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _distinct_buckets(bits: int):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    @forgetful
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher(bits)
        for batch in batches:
            yield pa.array([np.unique(hasher.buckets(t.as_py() or "")) for t in batch], pa.list_(pa.int32()))
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", per_class: int = PER_CLASS, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Learn from at most ``per_class`` rows of each label that are not held out."""
    marked = (labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    # Log-odds that the sample adds to those of all labelled rows.
    added = sum(sign * math.log(min(per_class, counts[y]) / counts[y]) for y, sign in ((1, 1), (0, -1)) if y in counts)
    sample = None
    for label in (0, 1):  # at most per_class narrow rows each: small enough to broadcast
        some = marked.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        sample = some if sample is None else sample.unionByName(some)
    rows = (texts.join(F.broadcast(sample), "id")
            .select("id", "label", _distinct_buckets(bits)(F.col("t")).alias("buckets"))
            .groupBy("id", "label").agg(F.min("buckets").alias("buckets")))

    @forgetful
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Ftrl(bits), set()
        for batch in batches:
            for label, buckets in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                learner.step(label, np.asarray(buckets.values))
                seen.add(label)
        if len(seen) == 2:
            m = learner.model()
            yield pa.RecordBatch.from_pydict({"bucket": [m.bucket], "weight": [m.weight], "bias": [m.bias]}, schema=pa.schema(
                [("bucket", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64())), ("bias", pa.float64())]))

    # The rows pass through the one training task as a sorted stream, once an epoch, and it
    # holds a batch of them and the weights.
    stream = (rows.select("label", "buckets", F.xxhash64("id").alias("order"), "id",
                          F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
              .repartition(1).sortWithinPartitions("epoch", "order", "id"))
    got = stream.select("label", "buckets").mapInArrow(train, "bucket array<int>, weight array<double>, bias double").collect()
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0), 0.0, bits, known=False)
    return Model(np.asarray(got[0].bucket, np.int32), np.asarray(got[0].weight, float), got[0].bias - added, bits)


def toxicity_score(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of a text column."""
    @F.arrow_udf(T.DoubleType())
    @forgetful
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, dense = Hasher(model.bits), model.dense()
        for batch in batches:
            yield pa.array([model.score(hasher.buckets(t.as_py() or ""), dense) for t in batch], pa.float64())
    return run(text)
