"""Pairs inside groups, counted in blocks: no group is gathered whole and no pair becomes a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize


def block_pairs(rows: DataFrame, sizes: DataFrame, keys: list[str], item: str, block: int) -> DataFrame:
    """Deal each group of rows into blocks of about `block` items, and each row to every pair with its block.

    sizes: keys, m (rows of the group, at least 2). Adds bi, bj (the pair, bi <= bj) and left, right
    (which side the row is on; both if bi = bj). A group of m rows gives each row about m / block copies.
    """
    dealt = rows.join(sizes, keys).withColumn("nb_", F.ceil(F.col("m") / block).cast("int"))
    dealt = dealt.withColumn("own_", F.pmod(F.xxhash64(F.lit(7), item), F.col("nb_")).cast("int"))
    dealt = dealt.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("nb_") - 1)))
    return dealt.select(
        *rows.columns,
        F.least("own_", "other_").alias("bi"),
        F.greatest("own_", "other_").alias("bj"),
        (F.col("own_") <= F.col("other_")).alias("left"),
        (F.col("own_") >= F.col("other_")).alias("right"),
    )


def meeting_blocks(rows: DataFrame, sizes: DataFrame, key: str, item: str, marks: str, block: int) -> DataFrame:
    """Like block_pairs, but a row is dealt only to the pairs with blocks in which some row shares one of its marks.

    rows: materialized; marks: a column of arrays; items are distinct. What is dealt is bounded by the pairs
    that share a mark, however large a group is that chains of such pairs make. The blocks that hold a mark
    travel as one sorted array, so a row meets one record for each of its marks, not one for each block.
    """
    own = hot_join(rows, sizes, [key], rows.count(), "m").withColumn("nb_", F.ceil(F.col("m") / block).cast("int"))
    own = own.withColumn("own_", F.pmod(F.xxhash64(F.lit(7), item), F.col("nb_")).cast("int"))
    placed = materialize(own.where("nb_ > 1").select(key, item, "own_", F.explode(marks).alias("mark_")), "marks")
    there = placed.groupBy(key, "mark_").agg(F.array_sort(F.collect_set("own_")).alias("others_"), F.count(F.lit(1)).alias("n_"))
    met = hot_join(placed, there, [key, "mark_"], placed.count(), "n_").groupBy(item).agg(F.collect_set("others_").alias("others_"))
    meets = met.select(item, F.explode(F.array_distinct(F.flatten("others_"))).alias("other_"))
    dealt = own.where("nb_ = 1").withColumn("other_", F.lit(0)).unionByName(own.where("nb_ > 1").join(meets, item))
    return dealt.select(
        *rows.columns,
        F.least("own_", "other_").alias("bi"),
        F.greatest("own_", "other_").alias("bj"),
        (F.col("own_") <= F.col("other_")).alias("left"),
        (F.col("own_") >= F.col("other_")).alias("right"),
    )


def over_groups(rows: DataFrame, keys: list[str], per_group: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, partitions: int | None = None) -> DataFrame:
    """Run per_group over each group's rows, streaming through sorted partitions (one Python call per batch, not per group)."""
    dealt = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None and len(held):
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cut = _starts(pdf, keys)
            done, held = pdf.iloc[: cut[-1]], pdf.iloc[cut[-1] :]
            if len(done):
                yield from groups(done, cut[:-1])
        if held is not None and len(held):
            yield from groups(held, _starts(held, keys))

    def groups(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        found = [x for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True) if b - a > 1 and (x := per_group(pdf.iloc[a:b])) is not None]
        if found:
            yield pd.concat(found, ignore_index=True)[names]

    return dealt.sortWithinPartitions(*keys).mapInPandas(run, schema)


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def linked(nodes_a: np.ndarray, nodes_b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame | None:
    """From links (i of a, j of b): per node, how many rows its links reach, and the smallest node of its local component."""
    if not len(i):
        return None
    ends = np.concatenate([nodes_a[i], nodes_b[j]])
    reach = np.concatenate([counts_b[j], counts_a[i]])
    nodes, at = np.unique(ends, return_inverse=True)
    links = np.zeros(len(nodes), "i8")
    np.add.at(links, at, reach)
    u, v = at[: len(i)], at[len(i) :]
    root = np.arange(len(nodes))
    while True:  # nodes are sorted, so the smallest index is the smallest node
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return pd.DataFrame({"node": nodes, "links": links, "root": nodes[root]})
