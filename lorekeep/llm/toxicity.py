"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices


@dataclass(frozen=True)
class Settings:
    """Size of the feature space, the learner's rates, and the bound of the training sample."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 5
    #: At most this many labelled rows are learned from, the smallest by a hash of their id.
    train_rows: int = 24_000
    #: Learners that share the sample; their weights are averaged.
    learners: int = 1
    #: A document is predicted toxic from this score on.
    threshold: float = 0.3


SETTINGS = Settings()
CACHE_WORDS = 300_000


class WordHash(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_table() -> bytes:
    """Lower-case A-Z; other ASCII bytes that are no digits or letters become spaces."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if c.isalnum() else 32
    return bytes(table)


TABLE = word_table()


def features(text: str | None, known: WordHash, bits: int) -> np.ndarray:
    """Distinct buckets of a text's words, pairs of neighbours and pairs with one word between."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    near = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] >> np.uint64(7))
    skip = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h[2:] >> np.uint64(9))
    mixed = np.concatenate([h, near * np.uint64(0xD6E8FEB86659FD93), skip * np.uint64(0xA0761D6478BD642F)])
    return np.unique(mixed >> shift).astype(np.int32)


class Ftrl:
    """FTRL-proximal: a rate of its own for each coordinate, and L1 that keeps most weights at zero."""

    def __init__(self, s: Settings):
        self.s, size = s, (1 << s.bits) + 1  # the last coordinate is the bias
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        s, z = self.s, self.z[at]
        return np.where(np.abs(z) <= s.l1, 0.0,
                        -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS) -> tuple[np.ndarray, np.ndarray]:
    """Weights that are not zero: (coordinates, values), at most ``2 ** bits + 1`` of them.

    ``labels`` has doc_id and toxic. The sample is bounded by ``train_rows``, so
    that side of the join is too. Each learner goes over its own part, in an order that
    the ids' hashes give; Spark averages the weights.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64(F.lit("toxicity"), "doc_id")
    sample = one.withColumn("_place", place).orderBy("_place").limit(s.train_rows)
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "text", "toxic", "_place", F.pmod("_place", F.lit(s.learners)).cast("int").alias("_part"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_place", "ascending"), ("text", "ascending")])
        known, model, bias = WordHash(), Ftrl(s), 1 << s.bits
        seen = [np.append(features(t.as_py(), known, s.bits), np.int32(bias)) for t in table.column("text")]
        label = table.column("toxic").to_pylist()
        for epoch in range(s.epochs):
            for i in np.random.default_rng(epoch).permutation(len(seen)):
                model.learn(seen[i], label[i])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array(at, pa.int64()), "w": pa.array(w[at])})

    fitted = rows.groupBy("_part").applyInArrow(fit, "at long, w double")
    mean = fitted.groupBy("at").agg((F.sum("w") / s.learners).alias("w")).orderBy("at").toPandas()
    return mean["at"].to_numpy(np.int64), mean["w"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], s: Settings = SETTINGS) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) of each whole text, computed where the row is."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = held.value
        dense = np.zeros((1 << s.bits) + 1)
        dense[at] = w
        known, bias = WordHash(), dense[-1]
        for batch in slices(batches, "text"):
            sums = np.array([bias + dense[features(t.as_py(), known, s.bits)].sum() for t in batch.column("text")])
            yield batch.append_column("toxicity", pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35)))))

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("toxicity", T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Learn from ``labels`` and add ``toxicity`` to every row of ``docs``.

    Only ids meet labels; a score depends on the text alone. A null or empty text has no
    words and gets the score of the bias; equal texts get equal scores. Without labels
    all weights are zero and all scores 0.5. Other columns pass through; one named
    ``toxicity`` is replaced.
    """
    return score(docs, train(docs, labels, s), s)


def remainder(doc_id: str = "doc_id"):
    """The fold of a document: crc32 of its id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def learnable(labels: DataFrame) -> DataFrame:
    """Labels of the rows that are not held out."""
    return labels.where(remainder() != 2)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with its score and prediction."""
    scored = score_toxicity(docs.select("doc_id", "text"), learnable(labels))
    return scored.select(
        "doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= SETTINGS.threshold).cast("int").alias("predicted"))
