"""Exact top-k search by distributed histogram selection.

Vectors and queries are dealt into blocks; every pair of blocks is scored. Each query keeps a score
interval that holds its k-th best score: a round of histograms over that interval is summed over all
blocks and the bin with the k-th score becomes the next interval, until the bins are one score wide.
Then the scores at or above the k-th are filtered and ties go to the smaller id. A block sends only
its bins from the top down to its own k-th score: the overall k-th score is never below those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

K = 20
SCALE = 64
VECTOR_BLOCK = 2048
QUERY_BLOCK = 512
BINS = 128


def quantized(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, q (floor(scale * x) of each component), n (rows that are so). Rows without an id, null, empty or with a null or non-finite component take no part."""
    x = F.col(embedding)
    good = F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(good).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")).alias("q")).groupBy("id", "q").agg(F.count(F.lit(1)).alias("n"))


def _blocks(rows: DataFrame, n: int, extra: list[str]) -> DataFrame:
    """One row per block of vectors of one dimension: the ids, the matrix in the smallest integers that hold it, and the extra columns."""
    schema = "dim int, b long, ids binary, matrix binary, kind string, extra binary"

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        matrix = np.stack(pdf["q"].to_numpy()).astype("<i8")
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if k == "<i8" or (np.iinfo(k).min <= matrix.min() and matrix.max() <= np.iinfo(k).max))
        more = np.stack([pdf[c].to_numpy() for c in extra], axis=1).astype("<i8")
        out = {"dim": key[0], "b": key[1], "ids": pdf["id"].to_numpy().astype("<i8").tobytes(), "matrix": matrix.astype(kind).tobytes(), "kind": kind, "extra": more.tobytes()}
        return pd.DataFrame({k: [v] for k, v in out.items()})

    return rows.withColumn("dim", F.size("q")).withColumn("b", F.pmod(F.xxhash64("id", "q"), F.lit(n))).groupBy("dim", "b").applyInPandas(pack, schema)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where every sum stays exact there, else in 64-bit integers."""
    bound = q.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0))
    if bound < 2**53:
        return np.rint(q.astype("f8") @ v.astype("f8").T).astype("i8")
    if bound >= 2**63:
        raise OverflowError("scores pass 64 bits")
    return q @ v.T


def _pairs(queries: DataFrame, vectors: DataFrame, n_q: int, n_v: int) -> DataFrame:
    """Every query block beside every vector block, by an equi-join on the block's number."""
    wide = queries.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_v - 1).cast("long"))))
    wide = wide.select("dim", "b", "v", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("kind").alias("q_kind"), F.col("extra").alias("q_extra"))
    wide = wide.repartition(max(1, min(n_q * n_v, 4096)), "dim", "b", "v")
    # packed blocks are larger in memory than in files, so their size must not invite a broadcast
    return wide.hint("merge").join(vectors.select("dim", F.col("b").alias("v"), "ids", "matrix", "kind", "extra"), ["dim", "v"])


def _opened(row) -> tuple:
    """Keys of the queries, ids and numbers of the vectors, scores, which vectors are the query's own, low or k-th scores."""
    keys, v_ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
    s = _scores(np.frombuffer(row.q_matrix, row.q_kind).reshape(len(keys), -1).astype("i8"), np.frombuffer(row.matrix, row.kind).reshape(len(v_ids), -1).astype("i8"))
    extra = np.frombuffer(row.q_extra, "<i8").reshape(len(keys), 2)
    return keys, v_ids, np.frombuffer(row.extra, "<i8"), s, v_ids[None, :] == extra[:, 1:], extra[:, :1]


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query by integer inner product.

    Vectors are floor(64 x) per component. A query is not its own candidate: rows with its vec_id are
    left out. Repeated rows are candidates each, and one query; queries of one vec_id with several vectors
    are answered each. Rows without a vec_id, null and empty vectors, and such with null or non-finite
    components take no part; vectors meet those of their own dimension. Fewer than k candidates: all of
    them. Ties go to the smaller vec_id. Empty tables give no rows; other columns are not read.
    """
    spark = rows.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score long"
    vectors = materialize(quantized(rows, vec_id, embedding), "topk-vectors")
    asked = quantized(queries, vec_id, embedding).select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("vec"), "q")
    asked = materialize(asked, "topk-queries")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    n_vectors, most = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    n_queries, most_q = asked.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not n_vectors or not n_queries:
        return spark.createDataFrame([], out_schema)
    n_v, n_q = math.ceil(n_vectors / VECTOR_BLOCK), math.ceil(n_queries / QUERY_BLOCK)
    v_blocks = materialize(_blocks(vectors, n_v, ["n"]), "topk-blocks")
    bound = math.ceil(most * most_q) + 1
    width = 1
    while width * BINS < 2 * bound + 1:
        width *= BINS
    # low: where the interval of BINS bins begins; above: scores already known to lie over it
    state = asked.withColumn("low", F.lit(-bound)).withColumn("above", F.lit(0).cast("long"))
    while True:
        state = materialize(state, "topk-state")

        def count(batches: Iterator[pd.DataFrame], width: int = width) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    keys, v_ids, times, s, own, low = _opened(row)
                    bins = (s - low) // width
                    bins[own | (s < low)] = -1
                    bins[bins >= BINS] = BINS
                    n = np.zeros((len(keys), BINS + 2), "i8")
                    np.add.at(n, (np.arange(len(keys))[:, None], bins + 1), times[None, :])
                    n[:, 0] = 0
                    # bins lower than the block's own k-th score cannot hold the overall one
                    over = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
                    n[over >= k] = 0
                    i, b = np.nonzero(n[:, :-1])
                    yield pd.DataFrame({"id": keys[i], "bin": b - 1, "n": n[i, b]})

        pairs = _pairs(_blocks(state, n_q, ["low", "vec"]), v_blocks, n_q, n_v)
        bins = pairs.mapInPandas(count, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin"))
        reach = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))
        found = bins.withColumn("reach", reach).join(state.select("id", "low", "above"), "id")
        # the first bin from the top with which k scores are reached; with fewer than k in all, the lowest
        full = F.col("above") + F.col("reach") >= k
        found = found.groupBy("id").agg(
            F.coalesce(F.max(F.when(full, F.col("bin"))), F.min("bin")).alias("bin"),
            F.max("low").alias("low"),
            F.max("above").alias("above"),
            F.collect_list(F.struct("bin", "n")).alias("bins"),
        )
        over = F.aggregate(F.filter("bins", lambda b: b["bin"] > F.col("bin")), F.lit(0).cast("long"), lambda a, b: a + b["n"])
        found = found.select(F.col("id").alias("id_"), (F.col("low") + F.col("bin") * width).alias("low_"), (F.col("above") + over).alias("above_"))
        state = asked.join(found, asked["id"] == found["id_"]).select("id", "vec", "q", F.col("low_").alias("low"), F.col("above_").alias("above"))
        if width == 1:
            break
        width //= BINS

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                keys, v_ids, times, s, own, kth = _opened(row)
                tied = (s == kth) & ~own
                tied &= np.cumsum(tied, axis=1) <= k  # ids ascend in a block, so these are the smallest
                i, j = np.nonzero(((s > kth) & ~own) | tied)
                yield pd.DataFrame({"id": keys[i], "vec_id": v_ids[j], "score": s[i, j], "n": np.minimum(times[j], k)})

    state = materialize(state, "topk-state")
    hits = _pairs(_blocks(state, n_q, ["low", "vec"]), v_blocks, n_q, n_v).mapInPandas(keep, "id long, vec_id long, score long, n long")
    hits = hits.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("id", F.col("vec").alias("query_id")), "id").select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.q, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 20 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
