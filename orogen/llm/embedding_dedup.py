"""Embedding near-duplicates: sign hashes of random hyperplanes in several tables, exact cosines, components.

Equal vectors become one node first. A node enters one bucket per table; buckets are compared in
blocks, a pair only in the first table in which its codes agree, so links are counted once although
no list of pairs is ever made. Tables are added until a pair at the threshold meets in one of them
with the target probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, documents, materialize
from .groups import block_pairs, linked, over_groups

THRESHOLD = 0.95
RECALL = 0.998
BLOCK = 1024
#: Pairs whose cosines are worked out at once.
CHUNK = 1 << 16


def tables_for(threshold: float, recall: float, bits: int) -> int:
    """Tables of `bits` signs so that a pair at the threshold shares a code with probability `recall`."""
    one = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def bits_for(n: int) -> int:
    """Signs per code: buckets of unrelated vectors hold about eight, whatever the table's size."""
    return min(30, max(8, math.ceil(math.log2(max(n, 2))) - 3))


def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n))


def link_embeddings(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bits: int | None = None, seed: int = 20240, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Links join rows whose cosine in double precision is at least the threshold; equal vectors link
    (also repeated rows, and rows of equal direction). Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and are their own component. component_id is the smallest vec_id
    reachable; a null vec_id is ignored in that unless all are null. Vectors of different lengths
    never link. An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    double = rows.schema[embedding].dataType.simpleString() != "array<float>"
    x = F.col(embedding).cast("array<double>") if double else F.col(embedding)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    given = rows.select(F.col(vec_id).alias("vec_id"), F.when(good, x).alias("x")).withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    given = materialize(given, "vectors")
    nodes = given.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"), F.first("x").alias("x"))
    nodes = materialize(nodes, "vector-nodes")
    n_nodes = nodes.count()
    k = bits or bits_for(n_nodes)
    n_tables = tables_for(threshold, recall, k)

    def encode(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            codes = np.empty((len(pdf), n_tables), "<i4")
            sizes = pdf["x"].map(len).to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                v = np.stack(pdf["x"].to_numpy()[at]).astype("f8")
                signs = (v @ _planes(int(dim), n_tables * k, seed) >= 0).reshape(len(at), n_tables, k)
                codes[at] = signs @ (1 << np.arange(k))
            vectors = [np.asarray(v).astype("<f8").tobytes() if np.asarray(v).dtype == "f8" else np.asarray(v, "<f4").tobytes() for v in pdf["x"]]
            yield pd.DataFrame({"node": pdf["node"], "n": pdf["n"], "code": list(codes), "wide": sizes, "v": vectors})

    coded = nodes.select("node", "n", "x").mapInPandas(encode, "node long, n long, code array<int>, wide int, v binary")
    coded = materialize(coded, "vector-codes")
    placed = coded.select("node", "n", F.posexplode("code").alias("table", "bucket"), "wide")
    sizes = placed.groupBy("table", "bucket", "wide").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = block_pairs(placed, sizes, ["table", "bucket", "wide"], "node", BLOCK)
    members = members.join(coded.select("node", "code", "v"), "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame | None:
        left, right = pdf["left"].to_numpy(), pdf["right"].to_numpy()
        same = pdf["bi"].iat[0] == pdf["bj"].iat[0]
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        codes = np.stack(pdf["code"].to_numpy())
        table = pdf["table"].iat[0]
        v = np.stack([np.frombuffer(x, "<f8" if double else "<f4") for x in pdf["v"]]).astype("f8")
        v /= np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        cos = v[a] @ v[b].T
        hit = cos >= threshold
        if same:
            hit &= a[:, None] < b[None, :]
        i, j = np.nonzero(hit)
        if len(i) and table:
            earlier = np.zeros(len(i), bool)
            for at in range(0, len(i), CHUNK):
                s = slice(at, at + CHUNK)
                earlier[s] = (codes[a[i[s]], :table] == codes[b[j[s]], :table]).any(axis=1)
            i, j = i[~earlier], j[~earlier]
        node, n = pdf["node"].to_numpy(), pdf["n"].to_numpy()
        return linked(node[a], node[b], n[a], n[b], i, j)

    found = over_groups(members, ["table", "bucket", "wide", "bi", "bj"], compare, "node long, links long, root long")
    found = materialize(found, "vector-links")
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "n", "low").join(links, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = given.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(documents(spark, sf_dir, "embeddings"))
