"""The bake: primitives evaluated over the samples of a tiled grid, as a binned spatial join and two ordered folds.

Only samples near a primitive become rows. A primitive is dealt to the tiles that its bounds touch, by an
equi-join on the tile's key; inside a tile its bounds name the range of samples; weights are worked out
there, and what weighs nothing goes before anything is shuffled. Samples that no primitive touches are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.frames import by_place, once, spread
from ..functions.scalars import clamp, num
from ..plans.graph import compile_graph
from . import shapes


@dataclass(frozen=True)
class World:
    """The grid and the range of heights."""

    tile_size: int = 1024
    tiles_per_side: int = 16
    unit: float = 1.0
    height: float = 1024.0
    water: float = 0.0

    @property
    def size(self) -> float:
        return self.tile_size * self.tiles_per_side * self.unit

    def to_world(self, tile: Column, sample: Column) -> Column:
        return K.sample_to_world(tile, sample, self.tile_size, self.tiles_per_side, self.unit)


def tiles(spark: SparkSession, world: World) -> DataFrame:
    """Every tile of depth 0: ty, tx and its box, from the tile count alone."""
    n, span = world.tiles_per_side, (world.tile_size - 1) * world.unit
    out = spark.range(n * n).select((F.col("id") / n).cast("int").alias("ty"), (F.col("id") % n).cast("int").alias("tx"))
    for axis, t in (("x", "tx"), ("z", "ty")):
        low = world.to_world(F.col(t), F.lit(0))
        out = out.withColumn(f"min{axis}", low).withColumn(f"max{axis}", low + span)
    return out


def samples(spark: SparkSession, world: World) -> DataFrame:
    """Every sample of depth 0: ty, tx, sy, sx, one row each."""
    n = world.tile_size * world.tiles_per_side
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).alias("gy"), (F.col("id") % n).alias("gx"))
    s = world.tile_size
    return grid.select(*[F.expr(e).cast("int").alias(a) for a, e in (("ty", f"gy div {s}"), ("tx", f"gx div {s}"), ("sy", f"gy % {s}"), ("sx", f"gx % {s}"))])


def to_tiles(prepared: DataFrame, world: World) -> DataFrame:
    """Prepared primitives beside the tiles that they touch (ty, tx), with the segments and bounds that matter there.

    Boxes are closed. A spline keeps the segments within half its width of the tile; its bounds shrink to those,
    and a tile near none of them is passed over.
    """

    def index(v: Column, up: bool) -> Column:
        # one tile more on either side, then the exact test on boxes
        t = F.floor((v + num(world.size / 2)) / num(world.tile_size * world.unit)).cast("int") + (0 if up else -1)
        return F.greatest(F.lit(0), F.least(F.lit(world.tiles_per_side - 1), t))

    span = num((world.tile_size - 1) * world.unit)
    near = prepared.withColumn("ty", F.explode(F.sequence(index(F.col("minz"), False), index(F.col("maxz"), True))))
    near = near.withColumn("tx", F.explode(F.sequence(index(F.col("minx"), False), index(F.col("maxx"), True))))
    low = {a: world.to_world(F.col(t), F.lit(0)) for a, t in (("x", "tx"), ("z", "ty"))}
    touch = F.lit(True)
    for a in "xz":
        touch = touch & (F.col(f"max{a}") >= low[a]) & (F.col(f"min{a}") <= low[a] + span)
    near = near.where(touch)
    pad = F.col("width") / 2

    def by_tile(s: Column) -> Column:
        out = F.lit(True)
        for a in "xz":
            out = out & (s[f"max{a}"] + pad >= low[a]) & (s[f"min{a}"] - pad <= low[a] + span)
        return out

    spline = F.col("type") == shapes.SPLINE
    near = once(spread(near, "ty", "tx", "id"), segments=F.when(spline, F.filter("segments", by_tile)).otherwise(F.col("segments"))).where(F.size("segments") > 0)
    box = {}
    for a in "xz":
        for fold, end, sign in ((F.array_min, "min", -1), (F.array_max, "max", 1)):
            box[f"{end}{a}"] = F.when(spline, fold(F.col("segments")[f"{end}{a}"]) + sign * pad).otherwise(F.col(f"{end}{a}"))
    return once(near, **box)


def weighted_samples(prepared: DataFrame, world: World) -> DataFrame:
    """One row for each sample and primitive of positive weight: ty, tx, sy, sx, wx, wz, w and the primitive's numbers."""
    near = to_tiles(prepared, world)
    x0, x1 = K.sample_range(F.col("minx"), F.col("maxx"), F.col("tx"), world.tile_size, world.tiles_per_side, world.unit)
    y0, y1 = K.sample_range(F.col("minz"), F.col("maxz"), F.col("ty"), world.tile_size, world.tiles_per_side, world.unit)
    near = once(near, x0=x0, x1=x1, y0=y0, y1=y1).where("x0 <= x1 and y0 <= y1")
    rows = near.withColumn("sy", F.explode(F.sequence(F.col("y0").cast("int"), F.col("y1").cast("int")))).withColumn("sx", F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))))
    rows = rows.withColumn("wx", world.to_world(F.col("tx"), F.col("sx"))).withColumn("wz", world.to_world(F.col("ty"), F.col("sy")))
    rows = once(rows, w=shapes.weight(F.col("wx"), F.col("wz"))).where("w > 0")
    return rows.select("ty", "tx", "sy", "sx", "wx", "wz", "w", "id", "ord", "type", "mode", "elevation", "noiseScale", "priority", "height", "fieldId")


def with_fields(rows: DataFrame, library: list[dict]) -> DataFrame:
    """Adds v: the value of the row's field at (wx, wz); null without a field, for an unknown and for an invalid one.

    A field sees the places of its own rows only; noise passes over the others.
    """
    value = F.lit(None).cast("double")
    for graph in library:
        own = F.col("fieldId") == graph["id"]
        column = compile_graph(graph, F.when(own, F.col("wx")), F.when(own, F.col("wz")))
        if column is not None:
            value = F.when(own, column.cast("double")).otherwise(value)
    return rows.withColumn("v", value)


def fold_areas(entries: Column, height: float) -> Column:
    """Elevation after the areas, in order of (priority, ord): each draws it to its target by its weight, kept as FLOAT."""

    def step(e: Column, a: Column) -> Column:
        target = F.when(a["v"].isNull(), a["target"]).otherwise(clamp(a["target"] + a["v"] * a["scale"], 0, height))
        return (e.cast("double") + (target - e.cast("double")) * a["w"]).cast("float")

    return F.aggregate(F.array_sort(entries), F.lit(0.0).cast("float"), step)


def fold_splines(start: Column, entries: Column, height: float) -> Column:
    """Elevation after the splines, in document order: each adds its share and the sum is clamped at once, kept as FLOAT."""

    def step(e: Column, m: Column) -> Column:
        return clamp(e.cast("double") + F.coalesce(m["v"], F.lit(1.0)) * m["height"] * m["w"], 0, height).cast("float")

    return F.aggregate(F.array_sort(entries), start, step)


def bake(primitives: DataFrame, world: World, library: list[dict] | None = None) -> DataFrame:
    """ty, tx, sy, sx, h: the 16-bit height of every sample that some primitive touches. All others are 0.

    Areas come first, splines after them. Disabled primitives, areas of fewer than three and splines of fewer than two
    anchors, and splines of no height take no part; an empty table gives no rows.
    """
    prepared = shapes.prepare(primitives).where((F.col("type") == shapes.AREA) | (F.col("height") > 0))
    rows = with_fields(weighted_samples(prepared, world), library or [])
    target = shapes.target_elevation(F.col("mode"), F.col("elevation"), world.water, world.height)
    area = F.struct("priority", "ord", target.alias("target"), F.col("noiseScale").alias("scale"), "w", "v")
    spline = F.struct("ord", "height", "w", "v")
    by_sample = rows.groupBy("ty", "tx", "sy", "sx").agg(
        F.collect_list(F.when(F.col("type") == shapes.AREA, area)).alias("areas"), F.collect_list(F.when(F.col("type") == shapes.SPLINE, spline)).alias("splines")
    )
    folded = once(by_sample, ground=fold_areas(F.col("areas"), world.height))
    folded = once(folded, elevation=fold_splines(F.col("ground"), F.col("splines"), world.height).cast("double"))
    return folded.select("ty", "tx", "sy", "sx", K.to_sample(F.col("elevation"), world.height).alias("h"))


def dense(baked: DataFrame, world: World) -> DataFrame:
    """Every sample of the grid with its height, 0 where the bake has none."""
    return samples(baked.sparkSession, world).join(baked, ["ty", "tx", "sy", "sx"], "left").withColumn("h", F.coalesce("h", F.lit(0)))


def evaluate_points(points: DataFrame, primitives: DataFrame, world: World) -> DataFrame:
    """points (id, x, z) with elevation, landform (id of the last area that weighs there) and mountain (the splines' sum).

    Unlike the bake this adds up all splines and clamps once, rounds nothing to FLOAT and knows no fields.
    Points go to primitives by the tile that holds them; points outside the world are evaluated like the others.
    Points at one place share one evaluation.
    """
    prepared = shapes.prepare(spread(primitives, "id"))
    step = num(world.tile_size * world.unit)
    cells = prepared.withColumn("cz", F.explode(F.sequence(F.floor(F.col("minz") / step), F.floor(F.col("maxz") / step))))
    cells = cells.withColumn("cx", F.explode(F.sequence(F.floor(F.col("minx") / step), F.floor(F.col("maxx") / step)))).withColumnRenamed("id", "primitive")
    target = shapes.target_elevation(F.col("mode"), F.col("elevation"), world.water, world.height)
    area = F.col("type") == shapes.AREA

    def folded(places: DataFrame) -> DataFrame:
        given = places.select("id", "x", "z", F.floor(F.col("x") / step).alias("cx"), F.floor(F.col("z") / step).alias("cz"))
        met = once(given.join(cells, ["cx", "cz"]).where(shapes.holds(F.col("x"), F.col("z"))), w=shapes.weight(F.col("x"), F.col("z"))).where("w > 0")
        found = met.groupBy("id").agg(
            F.collect_list(F.when(area, F.struct("priority", "ord", target.alias("target"), "w", "primitive"))).alias("areas"),
            F.collect_list(F.when(~area, F.struct("ord", (F.col("w") * F.greatest(F.lit(0.0), F.col("height"))).alias("add")))).alias("splines"),
        )
        base = F.aggregate(F.array_sort("areas"), F.lit(0.0), lambda e, a: e + (a["target"] - e) * a["w"])
        rise = F.aggregate(F.array_sort("splines"), F.lit(0.0), lambda s, m: s + m["add"])
        return found.select("id", base.alias("base"), rise.alias("mountain"), F.get(F.reverse(F.array_sort("areas")), F.lit(0))["primitive"].alias("landform"))

    out = by_place(points, folded, "left")
    mountain = F.coalesce("mountain", F.lit(0.0))
    return out.select("id", clamp(F.coalesce("base", F.lit(0.0)) + mountain, 0, world.height).alias("elevation"), "landform", mountain.alias("mountain"))

