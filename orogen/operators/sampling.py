"""Heights at points, chunk meshes, chunk plans and the choice of chunks for a view."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.scalars import clamp, num
from .bake import World

# Segments per chunk side, and the screen sizes in pixels above which a chunk is split.
SEGMENTS = 64
SPLIT_ORTHO = 620
SPLIT_NEAR_FAR = {"free": (1100, 1500), "character": (950, 1350)}
NEAR_SHARE, MARGIN = 0.42, 0.15


def _corners(rows: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, tx: Column, ty: Column) -> DataFrame:
    """Each row four times: gx, gy of a corner and the corner's share in a bilinear mean."""
    corners = [((x0, 1 - tx), (y0, 1 - ty)), ((x1, tx), (y0, 1 - ty)), ((x0, 1 - tx), (y1, ty)), ((x1, tx), (y1, ty))]
    parts = [F.struct(x.cast("int").alias("gx"), y.cast("int").alias("gy"), (wx * wy).alias("share")) for (x, wx), (y, wy) in corners]
    return rows.withColumn("corner_", F.explode(F.array(*parts))).select(*rows.columns, "corner_.*")


def heights_at(points: DataFrame, level0: DataFrame, world: World) -> DataFrame:
    """id, height at world points (id, x, z): bilinear inside the tile that holds the point, whose border is not crossed.

    level0: gy, gx, h. A point outside the world has a null height; a missing sample counts as 0.
    """
    half, size = num(world.size / 2), world.size
    given = points.withColumn("in_", (F.col("x") + half).between(0, size) & (F.col("z") + half).between(0, size))
    tile_x, px = K.world_to_sample(F.col("x"), world.tile_size, world.tiles_per_side, world.unit)
    tile_y, py = K.world_to_sample(F.col("z"), world.tile_size, world.tiles_per_side, world.unit)
    most = F.lit(world.tile_size - 1)
    inner = given.where("in_").select("id", tile_x.alias("tx"), tile_y.alias("ty"), px.alias("px"), py.alias("py"))
    x0, y0 = (F.greatest(F.lit(0), F.least(most, F.floor(c).cast("int"))) for c in ("px", "py"))
    base_x, base_y = F.col("tx") * world.tile_size, F.col("ty") * world.tile_size
    wide = _corners(inner, base_x + x0, base_x + F.least(most, x0 + 1), base_y + y0, base_y + F.least(most, y0 + 1), F.col("px") - x0, F.col("py") - y0)
    found = wide.join(level0.select("gy", "gx", "h"), ["gy", "gx"], "left").groupBy("id").agg(F.sum(F.coalesce("h", F.lit(0)) * F.col("share")).alias("raw"))
    return points.select("id").join(found, "id", "left").select("id", K.to_elevation(F.col("raw"), world.height).alias("height"))


def chunk_size(world: World, lod: Column) -> Column:
    return F.pow(F.lit(2.0), lod) * SEGMENTS * world.unit


def max_chunk_lod(world: World) -> int:
    """The level at which one chunk spans the world."""
    return max(0, math.ceil(math.log2(world.tile_size * world.tiles_per_side / SEGMENTS)))


def chunk_bounds(chunks: DataFrame, world: World) -> DataFrame:
    """Adds size, minx, minz, maxx, maxz to chunks (lod, cy, cx)."""
    out = chunks.withColumn("size", chunk_size(world, F.col("lod")))
    for axis, c in (("x", "cx"), ("z", "cy")):
        low = F.col(c) * F.col("size") - num(world.size / 2)
        out = out.withColumn(f"min{axis}", low).withColumn(f"max{axis}", low + F.col("size"))
    return out


def chunk_tiles(chunks: DataFrame, world: World) -> DataFrame:
    """lod, cy, cx, d, scale, y, x: the tiles that a chunk and one step around it need, at the depth of its level."""
    deepest = K.max_depth(world.tiles_per_side)
    out = chunks.withColumn("d", F.least(F.col("lod"), F.lit(deepest))).withColumn("scale", F.pow(F.lit(2.0), F.col("d")))
    step, side = F.pow(F.lit(2.0), F.col("lod")), F.lit(world.tile_size * world.tiles_per_side) / F.col("scale")
    last_tile = (F.lit(world.tiles_per_side) / F.col("scale") - 1).cast("int")
    for axis, c in (("x", "cx"), ("y", "cy")):
        start = F.col(c) * SEGMENTS * step
        low = F.floor(clamp((start - step) / F.col("scale"), 0, side - 1))
        high = F.ceil(clamp((start + SEGMENTS * step + step) / F.col("scale"), 0, side - 1))
        first, last = (F.least(last_tile, F.floor(v / world.tile_size).cast("int")) for v in (low, high))
        out = out.withColumn(axis, F.explode(F.sequence(first, last)))
    return out.select("lod", "cy", "cx", "d", "scale", "y", "x")


def chunk_mesh(chunks: DataFrame, levels: DataFrame, world: World, segments: int = SEGMENTS) -> DataFrame:
    """Vertices of chunks (lod, cy, cx): vy, vx, height, r, g, b, nx, ny, nz, radius (of the whole chunk).

    Heights are bilinear across tiles and held at the world's border; normals are central differences
    of one step on either side. levels: d, gy, gx, h of the whole pyramid; a missing sample counts as 0.
    """
    n, deepest = segments + 1, K.max_depth(world.tiles_per_side)
    grid = chunks.select("lod", "cy", "cx").withColumn("vy", F.explode(F.sequence(F.lit(-1), F.lit(n)))).withColumn("vx", F.explode(F.sequence(F.lit(-1), F.lit(n))))
    # the frame of one step around the chunk serves the normals; its corners serve nothing
    rim = [(F.col(v) < 0) | (F.col(v) > segments) for v in ("vy", "vx")]
    grid = grid.where(~(rim[0] & rim[1])).withColumn("d", F.least("lod", F.lit(deepest)))
    step, scale = F.pow(F.lit(2.0), F.col("lod")), F.pow(F.lit(2.0), F.col("d"))
    most = F.lit(world.tile_size * world.tiles_per_side) / scale - 1
    for axis, c, v in (("x", "cx", "vx"), ("y", "cy", "vy")):
        grid = grid.withColumn(f"p{axis}", clamp((F.col(c) * segments * step + F.col(v) * step) / scale, 0, most))
    x0, y0 = F.floor("px"), F.floor("py")
    wide = _corners(grid, x0, F.least(most, x0 + 1), y0, F.least(most, y0 + 1), F.col("px") - x0, F.col("py") - y0)
    keys = ["lod", "cy", "cx", "vy", "vx"]
    raw = wide.join(levels, ["d", "gy", "gx"], "left").groupBy(*keys).agg(F.sum(F.coalesce("h", F.lit(0)) * F.col("share")).alias("raw"))
    raw = raw.withColumn("height", K.to_elevation(F.col("raw"), world.height))
    row, column = Window.partitionBy("lod", "cy", "cx", "vy").orderBy("vx"), Window.partitionBy("lod", "cy", "cx", "vx").orderBy("vy")
    sx = F.lag("height").over(row) - F.lead("height").over(row)
    sz = F.lag("height").over(column) - F.lead("height").over(column)
    out = raw.withColumns({"sx": sx, "sz": sz}).where(f"vx between 0 and {segments} and vy between 0 and {segments}")
    long = F.sqrt(F.col("sx") * F.col("sx") + num(4 * world.unit**2) + F.col("sz") * F.col("sz"))
    normal = [(F.col("sx") / long).alias("nx"), (num(2 * world.unit) / long).alias("ny"), (F.col("sz") / long).alias("nz")]
    half = num(segments * world.unit / 2)
    lx, lz = F.col("vx") * num(world.unit) - half, F.col("vy") * num(world.unit) - half
    radius = F.sqrt(F.max(lx * lx + F.col("height") * F.col("height") + lz * lz).over(Window.partitionBy("lod", "cy", "cx")))
    return out.select(*keys, "height", *K.topo_color(F.col("raw") / 65535.0), *normal, radius.alias("radius"))


@dataclass(frozen=True)
class Camera:
    """An orthographic view (visible width and height in world units) or a perspective one (field of view in degrees)."""

    x: float
    z: float
    viewport: float
    visible: tuple[float, float] | None = None
    fov: float = 60.0
    mode: str = "free"


def in_view(camera: Camera) -> Column:
    """Whether bounded chunks meet the view, with a margin; a perspective view sees all."""
    if camera.visible is None:
        return F.lit(True)
    out = F.lit(True)
    for axis, at, span in (("x", camera.x, camera.visible[0]), ("z", camera.z, camera.visible[1])):
        margin = F.col("size") * MARGIN
        out = out & (F.col(f"max{axis}") >= num(at - span / 2) - margin) & (F.col(f"min{axis}") <= num(at + span / 2) + margin)
    return out


def splits(camera: Camera, world: World) -> Column:
    """Whether a bounded chunk looks large enough to be split."""
    if camera.visible is not None:
        return (F.col("lod") > 0) & (F.col("size") / num(camera.visible[1]) * num(camera.viewport) > SPLIT_ORTHO)
    gap = [F.greatest(F.col(f"min{a}") - num(v), num(v) - F.col(f"max{a}"), F.lit(0.0)) for a, v in (("x", camera.x), ("z", camera.z))]
    away = F.greatest(F.lit(1.0), F.hypot(*gap))
    pixels = F.col("size") / F.greatest(F.lit(1.0), away * num(2 * math.tan(math.radians(camera.fov) / 2))) * num(camera.viewport)
    near, far = SPLIT_NEAR_FAR["character" if camera.mode == "character" else "free"]
    return (F.col("lod") > 0) & (pixels > F.when(away < num(world.size * NEAR_SHARE), near).otherwise(far))


def select_chunks(spark: SparkSession, camera: Camera, world: World) -> DataFrame:
    """lod, cy, cx of the chunks to show: a descent from the root, one step of a bounded loop per level."""
    top = max_chunk_lod(world)
    level = spark.range(1).select(F.lit(top).alias("lod"), F.lit(0).alias("cy"), F.lit(0).alias("cx"))
    out = None
    for _ in range(top + 1):
        seen = chunk_bounds(level, world).where(in_view(camera))
        leaf = seen.where(~splits(camera, world)).select("lod", "cy", "cx")
        out = leaf if out is None else out.unionByName(leaf)
        four = F.array(*[F.struct((F.col("lod") - 1).alias("lod"), (F.col("cy") * 2 + j).alias("cy"), (F.col("cx") * 2 + i).alias("cx")) for j in (0, 1) for i in (0, 1)])
        level = seen.where(splits(camera, world)).select(F.explode(four).alias("c")).select("c.*")
    return out.orderBy(F.desc("lod"), "cy", "cx")


def selection_change(active: DataFrame, wanted: DataFrame) -> DataFrame:
    """lod, cy, cx, action: 'keep' what both have, 'build' what is new, 'release' what is no longer wanted."""
    keys = ["lod", "cy", "cx"]
    kept = wanted.join(active, keys, "left_semi").withColumn("action", F.lit("keep"))
    new = wanted.join(active, keys, "left_anti").withColumn("action", F.lit("build"))
    gone = active.join(wanted, keys, "left_anti").withColumn("action", F.lit("release"))
    return kept.unionByName(new).unionByName(gone).select(*keys, "action")


def missing_tiles(needed: DataFrame, held: DataFrame) -> DataFrame:
    """Tiles (d, y, x) that are needed and not held yet."""
    return needed.select("d", "y", "x").distinct().join(held, ["d", "y", "x"], "left_anti")


def selection_totals(chunks: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """tiles, vertices, triangles of a selection."""
    return chunks.agg(F.count(F.lit(1)).alias("tiles"), (F.count(F.lit(1)) * (segments + 1) ** 2).alias("vertices"), (F.count(F.lit(1)) * segments**2 * 2).alias("triangles"))


def units_per_pixel(camera: Camera, distance: Column) -> Column:
    """World units that one screen pixel spans."""
    if camera.visible is not None:
        return num(camera.visible[1] / max(1.0, camera.viewport))
    return F.greatest(F.lit(1.0), distance) * num(2 * math.tan(math.radians(camera.fov) / 2) / max(1.0, camera.viewport))
