"""Helpers that shape plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns added or replaced that are worked out once, however many expressions use them.

    The optimizer copies a column's formula into each expression that uses it; it does not look through a
    generator, and one row comes out for each row in.
    """
    rest = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("once_")
    return df.select(*rest, made).select(*rest, "once_.*")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over the cluster by key: for few rows that cause much work, which sizes in bytes do not show."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def by_place(points: DataFrame, work: Callable[[DataFrame], DataFrame], how: str = "inner") -> DataFrame:
    """work's rows for points (id, x, z), with work done once for all points that lie at one place.

    work gets the distinct places (id, x, z; id is the place itself) and returns rows with their id; each point's
    row gets those of its place. The join by place is a plain shuffle join, so a place of very many points can be split.
    """
    places = points.select("x", "z").distinct().select(F.struct("x", "z").alias("id"), "x", "z")
    found = work(places)
    found = found.select("id.x", "id.z", *[c for c in found.columns if c not in ("id", "x", "z")])
    return points.select("id", "x", "z").join(found, ["x", "z"], how).drop("x", "z")
