"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

FTRL-proximal passes with per-coordinate rates and L1 sparsity run over a sample of labelled rows in
one task, in one order at every size; the sample's bound is the parameter max_rows. What is broadcast
for scoring is the list of non-zero weights, whose size the L1 term and the sample's bound limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, sliced

#: Buckets of the feature hash.
DIM = 1 << 22
#: Most labelled rows that are learned from; the smallest hashes of doc_id are taken.
MAX_ROWS = 24_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.5
#: Rows in which a feature must occur to be learned.
LEAST = 3
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&…«»“”‘’-_"
CACHE = 150_000


class Features:
    """Hashed unigrams, bigrams and one-word skip-grams of a text's lowered words."""

    def __init__(self, dim: int = DIM):
        self.dim, self.known = dim, {}

    def _new(self, words: list[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        for w in set(words):
            if w not in self.known:
                self.known[w] = xxhash.xxh3_64_intdigest(w.strip(PUNCTUATION) or w)

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        try:
            h = np.array([known[w] for w in words], "u8")
        except KeyError:
            self._new(words)
            h = np.array([known[w] for w in words], "u8")
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        skip = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        out = np.concatenate([h, pair, skip])
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return (out >> np.uint64(64 - self.dim.bit_length() + 1)).astype("i4")


def ftrl(rows: list[np.ndarray], labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and their weights after FTRL-proximal passes; coordinate dim is the bias, free of L1.

    rows: distinct coordinates of each row, each of value 1; those in fewer than LEAST rows are passed over.
    """
    times = np.bincount(np.concatenate(rows), minlength=dim) if rows else np.zeros(dim, "i8")
    rows = [r[times[r] >= LEAST] for r in rows]
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    rng = np.random.default_rng(1)
    rows = [np.append(r, np.int32(dim)) for r in rows]

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        pull = np.where(at == dim, 0.0, l1)
        return np.where(np.abs(zi) <= pull, 0.0, -(zi - np.sign(zi) * pull) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[i]
            ni = n[at]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] += g - sigma * w
            n[at] = ni + g * g
    at = np.flatnonzero(z)
    w = weights(at)
    return at[w != 0], w[w != 0]


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """doc_id, text, label of at most `most` labelled rows outside the held-out fold, by smallest hash of doc_id.

    The sample's ids, at most `most`, are what is broadcast. Null labels and null doc_ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold_of(F.col("doc_id"), folds) != held)
    known = known.select("doc_id", F.col(label).cast("int").alias("label"), F.xxhash64("doc_id").alias("order_"))
    known = known.orderBy("order_", "doc_id", "label").limit(most).select(F.col("doc_id").alias("id_"), "label")
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id_")).select("doc_id", "text", "label")


def train(sample: DataFrame, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and weights (coordinate dim: bias) learned from sample: doc_id, text, label.

    The bias is moved to what it were if either label were as frequent, so a score does not depend
    on how rare toxic rows are.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(dim)
        for pdf in batches:
            found = [np.unique(features(t or "")) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "at": found})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        at, w = ftrl([np.asarray(x, "i4") for x in pdf["at"]], pdf["label"].to_numpy("f8"), dim)
        return pd.DataFrame({"at": [at.astype("i8").tobytes()], "w": [w.tobytes()]})

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = materialize(sample.mapInPandas(hashed, f"doc_id {kind}, label int, at array<int>"), "toxic-features")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return np.empty(0, "i8"), np.empty(0, "f8")
    found = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "at binary, w binary").first()
    at, w = np.frombuffer(found["at"], "i8"), np.frombuffer(found["w"], "f8").copy()
    w[at == dim] += np.log((n - toxic + 1) / (toxic + 1))
    return at, w


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], dim: int = DIM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: the logistic score of each whole text."""
    at, w = model
    bias = float(w[at == dim].sum())
    at, w = at[at < dim].astype("i4"), w[at < dim].astype("f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weight = Features(dim), np.zeros(dim, "f4")
        weight[at] = w
        for batch in sliced(batches):
            out = []
            for t in batch.column(1).to_pylist():
                found = features(t or "")
                found = np.unique(found[weight[found] != 0])
                out.append(1 / (1 + np.exp(-np.clip(bias + float(weight[found].sum(dtype="f8")), -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: toxic), predicted.

    Learns from `labels` (doc_id, toxic) whose crc32(doc_id) mod 3 is not 1. Null and empty texts get
    the score of a text without features; without any labelled row every score is 0.5; repeated rows
    are scored each. A null doc_id is not held out. An empty table gives no rows; other columns are not read.
    """
    sample = labelled(docs, labels, "toxic", 3, 1, max_rows)
    out = score(docs, train(sample))
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
