"""Editing: hit tests, nearest anchors and segments, transforms, changes of primitives, bounded history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import by_place, once, spread
from ..functions.scalars import num
from . import shapes
from .bake import World


def hit_threshold(world: World | None) -> float:
    """World units within which a pointer hits something."""
    # 24 units or 0.6 % of the world; 30 without one.
    return 30.0 if world is None else max(24.0, world.size * 0.006)


def nearby(pointers: DataFrame, features: DataFrame, reach: float) -> DataFrame:
    """pointers (id, x, z) beside features (minx, maxx, minz, maxz) whose box is within reach, by an equi-join on grid cells."""
    cell = num(max(reach, 1.0) * 4)
    given = pointers.withColumn("cz_", F.floor(F.col("z") / cell)).withColumn("cx_", F.floor(F.col("x") / cell))
    span = [F.sequence(F.floor((F.col(f"min{a}") - reach) / cell), F.floor((F.col(f"max{a}") + reach) / cell)) for a in "zx"]
    wide = features.withColumn("cz_", F.explode(span[0])).withColumn("cx_", F.explode(span[1]))
    return given.join(wide, ["cz_", "cx_"]).drop("cz_", "cx_")


def nearest_anchor(pointers: DataFrame, primitives: DataFrame, threshold: float) -> DataFrame:
    """id, primitive, anchor, distance: the nearest anchor within the threshold; of equally near ones the first in the document."""
    anchors = primitives.select(F.col("id").alias("primitive"), "ord", F.posexplode("anchors").alias("i", "a"))
    boxes = anchors.select("primitive", "ord", "i", F.col("a.id").alias("anchor"), F.col("a.x").alias("ax"), F.col("a.z").alias("az"))
    boxes = boxes.withColumns({f"{m}{a}": F.col(f"a{a}") for m in ("min", "max") for a in "xz"})
    met = nearby(pointers, boxes, threshold).withColumn("distance", F.hypot(F.col("x") - F.col("ax"), F.col("z") - F.col("az"))).where(F.col("distance") <= threshold)
    best = met.groupBy("id").agg(F.min(F.struct("distance", "ord", "i", "primitive", "anchor")).alias("b"))
    return best.select("id", "b.primitive", "b.anchor", "b.distance")


def nearest_segment(pointers: DataFrame, primitives: DataFrame, threshold: float) -> DataFrame:
    """id, primitive, insert_at, distance: where a new anchor goes on the nearest outline within the threshold.

    Only usable primitives count. Of equally near outlines the later in the document wins, inside one the first
    segment. On a smoothed open outline the step from one anchor's curve to the next is passed over.
    Pointers at one place share one search.
    """
    reach = max(18.0, threshold * 0.75)
    area = F.col("type") == shapes.AREA
    rows = once(spread(primitives.where(shapes.usable()), "id"), points=shapes.spline_points(F.col("anchors"), area, F.col("splineSmoothness")))
    raw = (F.coalesce("splineSmoothness", F.lit(shapes.SMOOTHNESS)) <= 0) | (F.size("anchors") < 3)
    n = F.size("points")
    pairs = F.transform(
        F.sequence(F.lit(0), F.when(area, n).otherwise(n - 1) - 1),
        lambda i: F.struct(i.alias("i"), F.get("points", i).alias("a"), F.get("points", F.pmod(i + 1, n)).alias("b")),
    )
    rows = rows.select(F.col("id").alias("primitive"), "ord", raw.alias("raw"), area.alias("closed"), F.size("anchors").alias("n_anchors"), n.alias("n"), F.explode(pairs).alias("s"))
    kept = F.col("raw") | (F.col("s.a.segment") == F.col("s.b.segment")) | (F.col("closed") & (F.col("s.i") == F.col("n") - 1))
    turn = F.pmod(F.col("s.a.segment") + 1, F.col("n_anchors"))
    at = F.when(F.col("raw"), F.col("s.i") + 1).otherwise(F.when(turn == 0, F.col("n_anchors")).otherwise(turn))
    rows = rows.where(kept).select("primitive", "ord", F.col("s.i").alias("i"), at.alias("insert_at"), *[F.col(f"s.{e}.{a}").alias(f"{e}{a}") for e in "ab" for a in "xz"])
    rows = rows.withColumns({f"{m}{a}": f(F.col(f"a{a}"), F.col(f"b{a}")) for m, f in (("min", F.least), ("max", F.greatest)) for a in "xz"})
    s = F.struct("ax", "az", "bx", "bz")

    def nearest(places: DataFrame) -> DataFrame:
        met = nearby(places, rows, reach).withColumn("s", s)
        met = met.withColumn("distance", F.sqrt(shapes.segment_distance2(F.col("x"), F.col("z"), F.col("s")))).where(F.col("distance") <= reach)
        return met.groupBy("id").agg(F.min(F.struct("distance", (-F.col("ord")).alias("later"), "i", "primitive", "insert_at")).alias("b"))

    best = by_place(pointers, nearest).groupBy("id").agg(F.min("b").alias("b"))
    return best.select("id", "b.primitive", "b.insert_at", "b.distance")


def primitive_hits(pointers: DataFrame, primitives: DataFrame, threshold: float) -> DataFrame:
    """id, primitive, rank: every primitive that a pointer hits, the last in the document first. Disabled ones count, too.

    An area is hit inside its outline and near it, a spline within half its width and somewhat more than near it.
    """
    area = F.col("type") == shapes.AREA
    rows = once(spread(primitives.where(F.size("anchors") >= 2), "id"), points=shapes.spline_points(F.col("anchors"), area, F.col("splineSmoothness")))
    reach = F.when(area, num(threshold)).otherwise(F.greatest(num(threshold * 1.6), F.coalesce(F.col("width"), num(0)) / 2))
    rows = once(rows, segments=shapes.segments_of(F.col("points"), area), reach=reach)
    box = {f"min{a}": F.array_min(F.col("points")[a]) - F.col("reach") for a in "xz"} | {f"max{a}": F.array_max(F.col("points")[a]) + F.col("reach") for a in "xz"}
    rows = once(rows, **box)
    rows = rows.select(F.col("id").alias("primitive"), "ord", "type", F.size("anchors").alias("n"), "segments", "reach", "minx", "maxx", "minz", "maxz")
    x, z = F.col("x"), F.col("z")
    near = shapes.distance(x, z, F.col("segments")) <= F.col("reach")
    hit = ((F.col("type") == shapes.AREA) & (F.col("n") >= 3) & shapes.inside(x, z, F.col("segments"))) | near
    met = nearby(spread(pointers, "id"), rows, threshold).where(shapes.holds(x, z))
    met = once(met, hit=hit).where("hit")
    return met.select("id", "primitive", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ord"))).alias("rank"))


def next_hit(hits: DataFrame, selected: DataFrame) -> DataFrame:
    """id, primitive: the hit after the selected one (id, selected), round to the first; the first if none is selected."""
    count = F.count(F.lit(1)).over(Window.partitionBy("id"))
    known = hits.withColumn("n", count).join(selected, "id", "left")
    at = F.max(F.when(F.col("primitive") == F.col("selected"), F.col("rank"))).over(Window.partitionBy("id"))
    known = known.withColumn("want", F.coalesce(F.pmod(at, F.col("n")) + 1, F.lit(1)))
    return known.where("rank = want").select("id", "primitive")


def translated(anchors: Column, dx, dz) -> Column:
    return F.transform(anchors, lambda a: F.struct(a["id"].alias("id"), (a["x"] + num(dx)).alias("x"), (a["z"] + num(dz)).alias("z")))


def rotated(anchors: Column, pivot: tuple[float, float], start: float, point: tuple[float, float]) -> Column:
    """Anchors turned about the pivot from the start angle to where the point now lies."""
    turn = math.atan2(point[1] - pivot[1], point[0] - pivot[0]) - start
    cos, sin = math.cos(turn), math.sin(turn)

    def moved(a: Column) -> Column:
        dx, dz = a["x"] - pivot[0], a["z"] - pivot[1]
        return F.struct(a["id"].alias("id"), (pivot[0] + dx * cos - dz * sin).alias("x"), (pivot[1] + dx * sin + dz * cos).alias("z"))

    return F.transform(anchors, moved)


def centroid(anchors: Column) -> Column:
    """Mean place of the anchors; null without any."""
    n = F.nullif(F.size(anchors), F.lit(0))
    return F.struct(*[(F.aggregate(anchors[a], num(0), lambda s, v: s + v) / n).alias(a) for a in "xz"])


def insert_anchor(anchors: Column, at: Column, anchor: Column) -> Column:
    return F.concat(F.slice(anchors, F.lit(1), at), F.array(anchor), F.slice(anchors, at + 1, F.size(anchors)))


def delete_anchor(primitives: DataFrame, primitive: str, anchor: str) -> DataFrame:
    """Without the anchor, if the primitive keeps as many as its type needs."""
    least = F.when(F.col("type") == shapes.AREA, 3).otherwise(2)
    left = F.filter("anchors", lambda a: a["id"] != anchor)
    return primitives.withColumn("anchors", F.when((F.col("id") == primitive) & (F.size(left) >= least), left).otherwise(F.col("anchors")))


def update_primitive(primitives: DataFrame, primitive: str, **values) -> DataFrame:
    """New values in one primitive's row."""
    on = F.col("id") == primitive
    return primitives.withColumns({k: F.when(on, F.lit(v).cast(primitives.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})


def delete_primitive(primitives: DataFrame, primitive: str) -> DataFrame:
    return primitives.where(F.col("id") != primitive)


def delete_field(primitives: DataFrame, fields: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """Fields without one, and primitives that no longer refer to it."""
    kept = F.when(F.col("fieldId") != field, F.col("fieldId"))
    return primitives.withColumn("fieldId", kept), fields.where(F.col("id") != field)


def last_versions(edits: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The last `most` edits of each key, newest first as rank 1."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return edits.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most)
