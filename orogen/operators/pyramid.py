"""The level-of-detail pyramid: each level is the rounded 2 x 2 mean of the stored level below.

Samples are in long form: d, gy, gx (place in the level's whole grid) and h. A level is one map-side
combined aggregation on the halved place; rounding makes every level depend on the stored one below,
so levels are built one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.scalars import half_up


def mean4() -> Column:
    """The half-up rounded mean of four samples; another number of them fails the query."""
    four = F.assert_true(F.count("h") == 4, F.lit("A parent sample needs exactly four children."))
    return F.when(four.isNull(), half_up(F.sum("h") / 4)).cast("int")


def next_level(level: DataFrame) -> DataFrame:
    """The level above: d + 1 and halved places."""
    up = [F.expr("d + 1").alias("d"), F.expr("gy div 2").cast("int").alias("gy"), F.expr("gx div 2").cast("int").alias("gx")]
    return level.groupBy(*up).agg(mean4().alias("h"))


def pyramid(base: DataFrame, levels: int) -> DataFrame:
    """All levels, the base (d = 0) included."""
    out, level = base, base
    for _ in range(levels):
        level = next_level(level)
        out = out.unionByName(level)
    return out


def sparse_next(level: DataFrame) -> DataFrame:
    """next_level for a base without its zeros: absent children count as 0 and parents that come out as 0 stay absent."""
    up = [F.expr("d + 1").alias("d"), F.expr("gy div 2").cast("int").alias("gy"), F.expr("gx div 2").cast("int").alias("gx")]
    return level.groupBy(*up).agg(half_up(F.sum("h") / 4).cast("int").alias("h")).where("h > 0")


def rebuild_dirty(stored: DataFrame, dirty: DataFrame, tile_size: int, tiles_per_side: int) -> DataFrame:
    """New rows of the ancestors of dirty tiles (x, y, d), level by level; all other tiles keep what stored has.

    stored: all levels. Only the four children of a dirty ancestor are read: a semi join on tile keys
    prunes the level below before it is aggregated. A tile that was rebuilt on the way replaces its stored form.
    """
    above = K.ancestors(dirty, tiles_per_side)
    out = None
    for d in range(1, K.max_depth(tiles_per_side) + 1):
        wanted = above.where(F.col("d") == d).select(F.col("x").alias("tx"), F.col("y").alias("ty"))
        below = stored.where(F.col("d") == d - 1)
        if out is not None:
            fresh = out.where(F.col("d") == d - 1)
            below = below.join(fresh.select("gy", "gx"), ["gy", "gx"], "left_anti").unionByName(fresh)
        below = below.withColumn("tx", F.expr(f"gx div {2 * tile_size}")).withColumn("ty", F.expr(f"gy div {2 * tile_size}"))
        level = next_level(below.join(wanted, ["tx", "ty"], "left_semi").select("d", "gy", "gx", "h"))
        out = level if out is None else out.unionByName(level)
    return out


def dirty_order(dirty: DataFrame, tiles_per_side: int) -> DataFrame:
    """The ancestors to rebuild, in the order in which they must be."""
    return K.ancestors(dirty, tiles_per_side).orderBy("d", "y", "x")


def usable_range(samples: DataFrame, by: list[str]) -> DataFrame:
    """Per group: whether heights differ by more than 64; a group without samples has no row."""
    # Fixed value: 64.
    return samples.groupBy(*by).agg((F.max("h") - F.min("h") > 64).alias("usable"))
