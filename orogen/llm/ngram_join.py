"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts with the same n-gram set become one node. Each node's MinHash signature is cut into bands and
nodes are shuffled on their band hashes; nodes that share a band hash are candidates. Candidate pairs
are verified on full n-gram sets, block by block inside the groups that candidates form: a node's set is
sent to the blocks that hold a candidate of its own, not to every pair, and links are counted without a
row for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, documents, materialize, sliced
from .groups import linked, meeting_blocks, over_groups

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 5
BLOCK = 128
#: Words that one worker keeps the hashes of; n-grams and columns handled at once.
CACHE, SPAN, COLUMNS = 100_000, 1 << 13, 1 << 13


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` values so that a pair at the threshold shares a band with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


class NgramSets:
    """Sorted 64-bit hashes of a text's distinct word n-grams (words are what split() gives).

    A text of fewer than n words has one n-gram, all its words; a text without words has none.
    """

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str) -> np.ndarray:
        words, known, n = text.split(), self.known, self.n
        if not words:
            return np.empty(0, "u8")
        try:
            h = np.array([known[w] for w in words], "u8")
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], "u8")
        if len(h) < n:
            h = np.concatenate([np.full(n - len(h), len(h), "u8"), h])
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
            out += h[i : len(h) - n + 1 + i]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


class MinHash:
    """Band hashes of a set: minima of keyed permutations of its 32-bit hashes, a band at a time."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rows = rows
        self.mix = rng.integers(0, 2**32, bands * rows, dtype="u4")[:, None]
        self.odd = (rng.integers(0, 2**31, bands * rows, dtype="u4") * np.uint32(2) + np.uint32(1))[:, None]

    def __call__(self, items: np.ndarray) -> np.ndarray:
        short = (items >> np.uint64(32)).astype("u4")
        low = np.full(len(self.odd), 2**32 - 1, "u4")
        for at in range(0, len(short), SPAN):
            keyed = short[None, at : at + SPAN] ^ self.mix
            keyed *= self.odd
            keyed ^= keyed >> np.uint32(15)
            keyed *= np.uint32(0x2C1B3C6D)
            np.minimum(low, keyed.min(axis=1), out=low)
        return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed=i) for i, x in enumerate(low.reshape(-1, self.rows))], "u8").view("i8")


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, minhash = NgramSets(n), MinHash(bands, rows)
        for batch in sliced(batches):
            nodes, found, last = [], [], {}
            for text in batch.column(3).to_pylist():
                items = sets(text)
                if not len(items):
                    nodes.append(None)
                    found.append(None)
                    continue
                node = xxhash.xxh3_64_intdigest(items.tobytes())
                if node not in last:
                    last[node] = minhash(items)
                nodes.append(node - (1 << 64) if node >> 63 else node)
                found.append(last[node])
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row_key", "bytes", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc_id {kind}, row_key long, bytes long, node long, bands array<long>")


def _with_sets(texts: DataFrame, n: int) -> DataFrame:
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = NgramSets(n)
        for batch in sliced(batches):
            found = [sets(t).astype("<u8").tobytes() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            keep = [batch.column(i) for i, f in enumerate(batch.schema.names) if f != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(found, pa.binary())], names=[f for f in batch.schema.names if f != "text"] + ["items"])

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(fill, f"{rest}, items binary")


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[j]: one by one if they are few, else as products of incidence matrices."""
    if len(i) <= 2 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(sets[a[x]], sets[b[y]], assume_unique=True)) for x, y in zip(i, j, strict=True)], "i8")
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), "f8")
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), "f4")
        held[owner[s:e], column[s:e] - low] = 1
        out += held[a] @ held[b].T
    return np.rint(out[i, j]).astype("i8")


def _judged(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What join_documents returns, and component: the smallest node of a row's class, null without n-grams."""
    bands = bands_for(threshold, recall, rows)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), F.octet_length(body).cast("long").alias("bytes"), body.alias("text"))
    signed = materialize(_signatures(given, n, bands, rows), "ngram-signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.min(F.struct("row_key", "bytes", "bands")).alias("of"))
    nodes = materialize(nodes.select("node", "n", "low", "of.*"), "ngram-nodes")
    placed = nodes.select("node", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("first")).where("m > 1")
    stars = placed.join(buckets, "band").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    groups = materialize(connected_components(stars, "ngram-candidates"), "ngram-groups")
    wanted = nodes.join(groups, "node").select("node", "n", "bands", F.col("component").alias("grp"), F.col("row_key").alias("of_key"), F.col("bytes").alias("of_bytes"))
    texts = given.join(wanted, (F.col("row_key") == F.col("of_key")) & (F.col("bytes") == F.col("of_bytes")))
    texts = texts.select("of_key", "of_bytes", "node", "n", "bands", "grp", "text").dropDuplicates(["of_key", "of_bytes", "node"]).drop("of_key", "of_bytes")
    members = materialize(_with_sets(texts, n), "ngram-sets")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = meeting_blocks(members, sizes, "grp", "node", "bands", BLOCK)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame | None:
        a, b = np.flatnonzero(pdf["left"].to_numpy()), np.flatnonzero(pdf["right"].to_numpy())
        band = np.stack(pdf["bands"].to_numpy())
        meet = np.zeros((len(a), len(b)), bool)
        for t in range(band.shape[1]):
            meet |= band[a, t][:, None] == band[b, t][None, :]
        if pdf["bi"].iat[0] == pdf["bj"].iat[0]:
            meet &= a[:, None] < b[None, :]
        sets = [np.frombuffer(x, "<u8") for x in pdf["items"]]
        size = np.array([len(s) for s in sets])
        meet &= np.minimum(size[a][:, None], size[b][None, :]) >= threshold * np.maximum(size[a][:, None], size[b][None, :]) - 1e-9
        i, j = np.nonzero(meet)
        if not len(i):
            return None
        both = _overlaps(sets, a, b, i, j)
        hit = both >= threshold * (size[a[i]] + size[b[j]] - both) - 1e-9
        node, times = pdf["node"].to_numpy(), pdf["n"].to_numpy()
        return linked(node[a], node[b], times[a], times[b], i[hit], j[hit])

    found = materialize(over_groups(dealt, ["grp", "bi", "bj"], verify, "node long, links long, root long"), "ngram-links")
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "ngram-classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "n", "low").join(links, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("low").alias("class_low"))
    known = known.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "class_low", "component")
    out = signed.select("doc_id", "row_key", "node").join(known, "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_low"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "row_key", "component").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("class_id"))
    )


def join_documents(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, class_id, n_links, kept, row_key.

    Two rows link if the Jaccard similarity of their sets of word n-grams is at least the threshold;
    n_links counts the other rows a row links with directly (copies included), class_id is the smallest doc_id
    reachable by links, kept says that it is the row's own. Null texts and texts without words have
    no n-grams and link with nothing, not even one another; texts of fewer than n words link if their words are equal. Repeated
    rows are copies of one another and share class and links. A null doc_id is ignored in class_id
    unless all of the class are null. An empty table gives no rows; other columns are not read.
    row_key tells rows apart as far as doc_id and text do.
    """
    return _judged(docs, **options).drop("component")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: the one of the smallest doc_id (and of equal ones, of the smallest text hash).

    Rows without words stay, except that repeated rows (equal doc_id and text) become one. All columns,
    whatever their names, are kept; of repeated rows that differ in them any one stays. An empty table stays empty.
    """
    judged = materialize(_judged(docs, **options), "ngram-judged")
    # classes may agree in class_id (all of their doc_ids null, or one doc_id with several texts), so each is known by its component
    pick = judged.where("kept and component is not null").groupBy("component").agg(F.min("row_key").alias("stay_")).select("stay_")
    stay = pick.unionByName(judged.where("component is null").select(F.col("row_key").alias("stay_"))).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    return keyed.join(stay, F.col("key") == F.col("stay_")).dropDuplicates(["key"]).select("row.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "kept")
