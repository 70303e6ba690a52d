"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is labelled good or bad from binned features of its own and of its neighbouring lines.
Forward-backward marginals, weighted by the lines' lengths, add up to the document's quality. With two
labels the chain's messages are one log-ratio per line, worked out for many documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sliced
from .toxicity import fold_of, labelled

#: Most labelled rows that are learned from; the smallest hashes of doc_id are taken.
MAX_ROWS = 12_000
#: Lines of a training chain; a longer document is learned from as several chains.
CHAIN = 64
STEPS, RATE, DECAY = 150, 0.1, 1e-3
#: Bytes whose features are worked out at once.
SPAN = 1 << 20
BINS = 12

_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _SYMBOL, _HIGH = range(7)
_CLASS = np.full(256, _HIGH, "u1")
_CLASS[:128] = _SYMBOL
for _c, _chars in ((_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_DIGIT, "0123456789"), (_SPACE, " \t\r\x0b\x0c"), (_MARK, ".,;:'\"()-?")):
    _CLASS[[ord(x) for x in _chars]] = _c
_SHARE = np.array([0.005, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45, 0.7])
_WORD = np.array([2, 3, 4, 4.75, 5.5, 6.25, 7, 8, 10, 14, 25])
_DISTINCT = np.array([0.08, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95])
_SIZE = np.array([1, 8, 24, 60, 120, 200, 320, 500, 800, 1500, 4000])
#: Features of a line itself; those of NEAR are taken from the line before and the line after, too.
OWN = ("upper", "symbol", "mark", "digit", "word", "size", "again", "place", "echo")
NEAR = ("upper", "symbol", "word", "size", "again", "echo")
GROUPS = len(OWN) + 2 * len(NEAR)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, bytes of each line, and each line's bins (one column per feature group).

    Lines are what lies between line feeds; blank ones are passed over, a text of only such ones has
    one empty line. Bin 0 of a neighbour's feature says that there is no such line.
    """
    counts, pieces, again, distinct = np.empty(len(texts), "i8"), [], [], []
    for i, text in enumerate(texts):
        lines = [x for x in text.split("\n") if x and not x.isspace()] or [""]
        counts[i] = len(lines)
        seen: dict[str, int] = {}
        for x in lines:
            n = seen.get(x, 0)
            seen[x] = n + 1
            again.append(n)
            words = x.split()
            distinct.append(len(set(words)) / max(len(words), 1))
        pieces.extend(lines)
    data = np.frombuffer("\n".join([*pieces, ""]).encode(), "u1")
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kinds = _CLASS[data]
    n = np.stack([np.add.reduceat(kinds == c, starts, dtype="i4") for c in range(7)], axis=1).astype("f8")
    n[:, _SYMBOL] -= 1  # the line feed
    size = (ends - starts).astype("f8")
    words = n[:, _SPACE] + 1
    dark = np.maximum(size - n[:, _SPACE], 1)
    letters = np.maximum(n[:, _UPPER] + n[:, _LOWER], 1)
    docs = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[True], docs[1:] != docs[:-1]])
    last = np.concatenate([first[1:], [True]])
    own = {
        "upper": np.searchsorted(_SHARE, n[:, _UPPER] / letters),
        "symbol": np.searchsorted(_SHARE, n[:, _SYMBOL] / dark),
        "mark": np.searchsorted(_SHARE, n[:, _MARK] / dark),
        "digit": np.searchsorted(_SHARE, n[:, _DIGIT] / dark),
        "word": np.searchsorted(_WORD, dark / words),
        "size": np.searchsorted(_SIZE, size),
        "again": np.minimum(np.array(again), 3),
        "echo": np.searchsorted(_DISTINCT, np.array(distinct)),
        "place": first * 1 + last * 2,
    }
    columns = [own[k] for k in OWN]
    for k in NEAR:
        v = np.minimum(own[k] + 1, BINS - 1)
        columns.append(np.where(first, 0, np.concatenate([[0], v[:-1]])))
        columns.append(np.where(last, 0, np.concatenate([v[1:], [0]])))
    return counts, size, np.stack(columns, axis=1).astype("u1")


class Chain:
    """Weights of the good label against the bad one, and of the steps (from, to) between labels 1 and 0."""

    def __init__(self, w: np.ndarray | None = None, step: np.ndarray | None = None):
        self.w = np.zeros((GROUPS, BINS)) if w is None else w
        self.step = np.zeros((2, 2)) if step is None else step

    def leaning(self, bins: np.ndarray) -> np.ndarray:
        """Each line's own log-odds of being good."""
        return self.w[np.arange(GROUPS)[None, :], bins].sum(axis=1)

    def messages(self, e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward (with the line's own) and backward log-ratios of every line, documents side by side."""
        s = self.step
        start = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        start, size = start[order], counts[order]
        forward, backward = e.copy(), np.zeros(len(e))
        longest = int(size[0]) if len(size) else 0
        active = [np.searchsorted(-size, -t, side="left") for t in range(longest)]  # documents of more than t lines
        for t in range(1, longest):
            at = start[: active[t]] + t
            a = forward[at - 1]
            forward[at] += np.logaddexp(a + s[1, 1], s[0, 1]) - np.logaddexp(a + s[1, 0], s[0, 0])
        for t in range(longest - 1, 0, -1):
            at = start[: active[t]] + t
            b = e[at] + backward[at]
            backward[at - 1] = np.logaddexp(b + s[1, 1], s[1, 0]) - np.logaddexp(b + s[0, 1], s[0, 0])
        return forward, backward

    def quality(self, counts: np.ndarray, size: np.ndarray, bins: np.ndarray) -> np.ndarray:
        forward, backward = self.messages(self.leaning(bins), counts)
        good = 1 / (1 + np.exp(-np.clip(forward + backward, -35, 35)))
        weight = np.maximum(size, 1)
        at = np.cumsum(counts) - counts
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)


def gradients(chain: Chain, counts: np.ndarray, bins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood of labels (one per line) by weights and by steps; weight: of each line, and of the step into it."""
    s = chain.step
    start = np.cumsum(counts) - counts
    inner = np.ones(len(labels), bool)
    inner[start] = False
    here = np.flatnonzero(inner)  # lines with one before them in their chain
    flat = bins.astype("i8") + np.arange(GROUPS)[None, :] * BINS
    was, now = labels[here - 1], labels[here]
    e = chain.leaning(bins)
    f, b = chain.messages(e, counts)
    good = 1 / (1 + np.exp(-np.clip(f + b, -35, 35)))
    g_line = (labels - good) * weight
    g_w = np.bincount(flat.ravel(), np.repeat(g_line, GROUPS), minlength=GROUPS * BINS)
    later = e[here] + b[here]
    pair = np.stack([np.full(len(here), s[0, 0]), s[0, 1] + later, s[1, 0] + f[here - 1], s[1, 1] + f[here - 1] + later], axis=1)
    pair = np.exp(pair - pair.max(axis=1, keepdims=True))
    pair /= pair.sum(axis=1, keepdims=True)
    seen = np.zeros_like(pair)
    seen[np.arange(len(here)), (2 * was + now).astype("i8")] = 1
    g_s = ((seen - pair) * weight[here][:, None]).sum(axis=0)
    return g_w.reshape(GROUPS, BINS), g_s.reshape(2, 2)


def fit(counts: np.ndarray, bins: np.ndarray, labels: np.ndarray) -> Chain:
    """Maximum likelihood by Adam; labels: one per line. Either label weighs the same in all.

    A longer document is several chains, so the steps are learned from all its neighbours but those at
    every CHAIN-th line; scoring runs over whole documents.
    """
    w, s = np.zeros((GROUPS, BINS)), np.zeros((2, 2))
    chain = Chain(w, s)
    share = max(labels.mean(), 1e-6)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-6)) / len(labels)
    moments = [np.zeros(GROUPS * BINS + 4) for _ in range(2)]
    for turn in range(1, STEPS + 1):
        g_w, g_s = gradients(chain, counts, bins, labels, weight)
        g = np.concatenate([(g_w - DECAY * w).ravel(), (g_s - DECAY * s).ravel()])
        moments[0] += 0.1 * (g - moments[0])
        moments[1] += 0.01 * (g * g - moments[1])
        move = RATE * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.99**turn)) + 1e-9)
        w += move[:-4].reshape(w.shape)
        s += move[-4:].reshape(2, 2)
    return chain


def train(sample: DataFrame) -> Chain:
    """Learn from sample: doc_id, text, label (1: good); its rows are bounded, so one task holds them.

    A document's label stands for all its lines. Without rows every weight is 0.
    """

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        counts, _, bins = line_features([t or "" for t in pdf["text"]])
        labels = np.repeat(pdf["label"].to_numpy("f8"), counts)
        chains = np.concatenate([np.diff([*range(0, c, CHAIN), c]) for c in counts])
        chain = fit(chains, bins, labels)
        return pd.DataFrame({"w": [chain.w.ravel().tolist()], "step": [chain.step.ravel().tolist()]})

    got = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "w array<double>, step array<double>").collect()
    return Chain(np.array(got[0]["w"]).reshape(GROUPS, BINS), np.array(got[0]["step"]).reshape(2, 2)) if got else Chain()


def scores(texts: list[str], chain: Chain) -> np.ndarray:
    """The length-weighted share of good lines of each whole text, worked out in spans of bounded size."""
    out, at = [np.empty(0)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SPAN):
            size += len(texts[end])
            end += 1
        out.append(chain.quality(*line_features(texts[at:end])))
        at = end
    return np.concatenate(out)


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score."""
    w, step = chain.w, chain.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(w, step)
        for batch in sliced(batches, 1024):
            found = scores([t or "" for t in batch.column(1).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: good), predicted.

    Learns from `labels` (doc_id, quality) whose crc32(doc_id) mod 5 is not 0. Null and empty texts are
    one empty line; without any labelled row every score is 0.5; repeated rows are scored each. A null
    doc_id is not held out. An empty table gives no rows; other columns are not read.
    """
    out = score(docs, train(labelled(docs, labels, "quality", 5, 0, max_rows)))
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs, all their columns, whose texts score at least the threshold.

    Null and empty texts are judged as one empty line, repeated rows each; without any labelled row all
    stay. An empty table stays empty.
    """
    chain = train(labelled(docs, labels, "quality", 5, 0, max_rows))
    w, step, text = chain.w, chain.step, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(w, step)
        for batch in sliced(batches, 1024):
            found = scores([t or "" for t in batch.column(text).to_pylist()], model)
            yield batch.filter(pa.array(found >= threshold))

    names = [f"c{i}" for i in range(len(docs.columns))]  # names with dots do not pass
    out = docs.toDF(*names)
    return out.mapInArrow(run, out.schema).toDF(*docs.columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
