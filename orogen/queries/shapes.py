"""Primitives, weights, the bake, point evaluation and editing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import by_place, once, spread
from ..operators import bake as B
from ..operators import editing as E
from ..operators import pyramid as P
from ..operators import shapes as G
from ..plans.presets import presets
from .inputs import POINTS, SHAPES, WORLD, points, primitives, table, weights_sql

THRESHOLD = E.hit_threshold(WORLD)


def _near(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Places beside the prepared primitives whose box holds them, met on grid cells."""
    return E.nearby(places, G.prepare(spread(rows, "id")).withColumnRenamed("id", "primitive"), 50.0).where(G.holds(F.col("x"), F.col("z")))


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = primitives(spark, sf_dir).where(F.col("type") == G.AREA)
    return by_place(points(spark, sf_dir), lambda places: _near(places, areas).where(G.inside(F.col("x"), F.col("z"), F.col("segments"))).select("id", "primitive"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, z = F.col("x"), F.col("z")

    def weighed(places: DataFrame) -> DataFrame:
        rows = once(_near(places, primitives(spark, sf_dir)), w=G.weight(x, z), distance=G.distance(x, z, F.col("segments"))).where("w > 0")
        # rounds the product, as DuckDB does: F.round sees the decimal digits, so halves can differ in the last place
        return rows.select("id", "primitive", *[(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("w", "distance")])

    return by_place(points(spark, sf_dir), weighed)


def spline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = primitives(spark, sf_dir).select("id", F.posexplode(G.spline_points(F.col("anchors"), F.col("type") == G.AREA, F.col("splineSmoothness"))).alias("j", "p"))
    return rows.select("id", "j", F.round("p.x", 7).alias("x"), F.round("p.z", 7).alias("z"), F.col("p.segment").alias("segment"))


def running_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.running_lengths(G.prepare(primitives(spark, sf_dir)))
    return rows.select("id", "i", F.round("length", 6).alias("length"), F.round("start", 6).alias("start"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.prepare(primitives(spark, sf_dir)).select("id", *[F.round(c, 7).alias(c) for c in ("minx", "maxx", "minz", "maxz")])


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.prepare(primitives(spark, sf_dir)).where(F.col("type") == G.SPLINE).select("id", F.posexplode(G.corridor(F.col("points"), F.col("width") / 2)).alias("j", "p"))
    return rows.select("id", "j", F.round("p.x", 6).alias("x"), F.round("p.z", 6).alias("z"))


def tile_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.to_tiles(G.prepare(primitives(spark, sf_dir)), WORLD)
    return rows.select("id", "ty", "tx", F.when(F.col("type") == G.SPLINE, F.size("segments")).otherwise(-1).alias("segments"))


def bake_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bake(primitives(spark, sf_dir), WORLD)


def bake_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = WORLD.tile_size
    level = B.bake(primitives(spark, sf_dir), WORLD).select(F.lit(0).alias("d"), (F.col("ty") * size + F.col("sy")).alias("gy"), (F.col("tx") * size + F.col("sx")).alias("gx"), "h").where("h > 0")
    out = level
    for _ in range(2):
        level = P.sparse_next(level)
        out = out.unionByName(level)
    return out


def bake_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bake with noise fields: areas and splines refer to the presets in turn."""
    names = F.array(*[F.lit(p["id"]) for p in presets()], F.lit("unknown"))
    rows = primitives(spark, sf_dir).withColumn("fieldId", F.element_at(names, (F.pmod(F.col("ord"), F.lit(7)) + 1).cast("int")))
    rows = rows.withColumn("noiseScale", F.when(F.col("type") == G.AREA, F.lit(80.0)))
    return B.bake(rows, WORLD, presets())


def point_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.evaluate_points(points(spark, sf_dir), primitives(spark, sf_dir), WORLD)
    return out.select("id", F.round("elevation", 6).alias("elevation"), "landform", F.round("mountain", 6).alias("mountain"))


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.nearest_anchor(points(spark, sf_dir), primitives(spark, sf_dir), THRESHOLD)
    return out.withColumn("distance", F.round("distance", 6))


def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.nearest_segment(points(spark, sf_dir), primitives(spark, sf_dir), THRESHOLD)
    return out.withColumn("distance", F.round("distance", 6))


def primitive_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_place(points(spark, sf_dir).distinct(), lambda places: E.primitive_hits(places, primitives(spark, sf_dir), THRESHOLD))


def cycle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cycled(places: DataFrame) -> DataFrame:
        hits = E.primitive_hits(places, primitives(spark, sf_dir), THRESHOLD)
        return E.next_hit(hits, hits.where("rank = 2").select("id", F.col("primitive").alias("selected")))

    return by_place(points(spark, sf_dir).distinct(), cycled)


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = primitives(spark, sf_dir)
    moved = rows.withColumns({"t": E.translated(F.col("anchors"), 12.5, -7.25), "r": E.rotated(F.col("anchors"), (10.0, 20.0), 0.25, (110.0, 70.0)), "c": E.centroid(F.col("anchors"))})
    moved = moved.select("id", "c", F.posexplode(F.arrays_zip("t", "r")).alias("i", "p"))
    six = {"tx": "p.t.x", "tz": "p.t.z", "rx": "p.r.x", "rz": "p.r.z", "cx": "c.x", "cz": "c.z"}
    return moved.select("id", "i", *[F.round(v, 6).alias(k) for k, v in six.items()])


def anchor_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = primitives(spark, sf_dir)
    new = F.struct(F.lit("new").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("z"))
    rows = rows.withColumn("anchors", E.insert_anchor(F.col("anchors"), F.pmod(F.col("ord"), F.lit(5)), new))
    rows = E.delete_primitive(E.update_primitive(E.delete_anchor(rows, "area-3", "area-3-1"), "area-4", enabled=False, elevation=77.0), "area-5")
    return rows.select("id", "enabled", F.round("elevation", 6).alias("elevation"), F.array_join(F.transform("anchors", lambda a: a["id"]), ",").alias("anchors"))


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.documents import type_counts as counts

    return counts(primitives(spark, sf_dir))


def area_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered FLOAT fold by nation: customers as layers in key order."""
    c = table(spark, sf_dir, "customer")
    layer = F.struct(F.lit(0.0).alias("priority"), F.col("c_custkey").alias("ord"), (F.col("c_acctbal") / 10).alias("target"), F.lit(0.0).alias("scale"), (F.col("c_custkey") % 10 / 10).alias("w"), F.lit(None).cast("double").alias("v"))
    areas = c.groupBy("c_nationkey").agg(F.collect_list(layer).alias("areas"))
    add = F.struct(F.col("c_custkey").alias("ord"), (F.col("c_acctbal") / 10).alias("height"), (F.col("c_custkey") % 10 / 10).alias("w"), F.lit(None).cast("double").alias("v"))
    splines = c.groupBy("c_nationkey").agg(F.collect_list(add).alias("splines"))
    out = areas.join(splines, "c_nationkey").withColumn("a", B.fold_areas(F.col("areas"), 1000.0))
    return out.select("c_nationkey", F.col("a").cast("double").alias("areas"), B.fold_splines(F.lit(0.0).cast("float"), F.col("splines"), 1000.0).cast("double").alias("splines"))


_S = f"WITH {SHAPES}"
_W = f"WITH {SHAPES}, {POINTS}, {weights_sql('points')}"
_TARGET = f"greatest(0::DOUBLE, least({WORLD.height}::DOUBLE, CASE WHEN mode = 'water' THEN least(elevation, {WORLD.water - 1}::DOUBLE) ELSE greatest(elevation, {WORLD.water + 1}::DOUBLE) END))"
_N = WORLD.tile_size * WORLD.tiles_per_side
_BAKE = f"""WITH {SHAPES}, grid AS (
  SELECT gy * {_N} + gx AS id, gx * 10.0::DOUBLE - 1280 AS x, gy * 10.0::DOUBLE - 1280 AS z FROM range({_N}) a(gy), range({_N}) b(gx)
), {weights_sql('grid')}, used AS (
  SELECT * FROM met WHERE w > 0 AND (type = 'landformArea' OR height > 0)
), areas AS (
  SELECT id, list_reduce(list_prepend({{'p': 0::DOUBLE, 'o': 0, 't': 0::DOUBLE, 'w': 0::DOUBLE, 'e': 0::FLOAT}},
    list({{'p': priority, 'o': ord, 't': {_TARGET}, 'w': w, 'e': 0::FLOAT}} ORDER BY priority, ord)),
    lambda a, m: {{'p': 0::DOUBLE, 'o': 0, 't': 0::DOUBLE, 'w': 0::DOUBLE, 'e': (a.e::DOUBLE + (m.t - a.e::DOUBLE) * m.w)::FLOAT}}).e AS e FROM used WHERE type = 'landformArea' GROUP BY id
), both_ AS (
  SELECT id, list({{'h': height, 'w': w, 'e': 0::FLOAT}} ORDER BY ord) FILTER (WHERE type = 'mountainSpline') AS ms FROM used GROUP BY id
), base AS (
  SELECT b.id, coalesce(a.e, 0::FLOAT) AS e, ms FROM both_ b LEFT JOIN areas a USING (id)
), done AS (
  SELECT id, CASE WHEN ms IS NULL THEN e ELSE list_reduce(list_prepend({{'h': 0::DOUBLE, 'w': 0::DOUBLE, 'e': e}}, ms),
    lambda a, m: {{'h': 0::DOUBLE, 'w': 0::DOUBLE, 'e': greatest(0::DOUBLE, least({WORLD.height}::DOUBLE, a.e::DOUBLE + 1::DOUBLE * m.h * m.w))::FLOAT}}).e END AS e FROM base
), baked AS (
  SELECT (id // {_N})::INT AS gy, (id % {_N})::INT AS gx, floor(greatest(0::DOUBLE, least({WORLD.height}::DOUBLE, e::DOUBLE)) / {WORLD.height}::DOUBLE * 65535::DOUBLE + 0.5)::INT AS h FROM done
)"""
_SEGMENTS = """span AS (
  SELECT p.id, p.x, p.z, e.*, (bx - ax) * (bx - ax) + (bz - az) * (bz - az) AS l2 FROM points p JOIN (SELECT pid, * EXCLUDE (pid) FROM edges) e
  ON p.x BETWEEN least(ax, bx) - 60 AND greatest(ax, bx) + 60 AND p.z BETWEEN least(az, bz) - 60 AND greatest(az, bz) + 60
), part AS (
  SELECT *, CASE WHEN l2 = 0 THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, ((x - ax) * (bx - ax) + (z - az) * (bz - az)) / l2)) END AS t FROM span
), far AS (
  SELECT *, sqrt((x - (ax + (bx - ax) * t)) * (x - (ax + (bx - ax) * t)) + (z - (az + (bz - az) * t)) * (z - (az + (bz - az) * t))) AS d FROM part
)"""
_HITS = f"""WITH {SHAPES}, {POINTS}, {_SEGMENTS.replace('60', '100')}, reach AS (
  SELECT pid, ord, type, CASE WHEN type = 'landformArea' THEN {THRESHOLD} ELSE greatest({THRESHOLD * 1.6}, width / 2) END AS r FROM prim
), nigh AS (
  SELECT id, f.pid FROM far f JOIN reach USING (pid) GROUP BY id, f.pid, r HAVING min(d) <= r
), box2 AS (
  SELECT pid, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM pts JOIN prim USING (pid) WHERE type = 'landformArea' GROUP BY pid
), within AS (
  SELECT p.id, e.pid FROM points p JOIN box2 b ON p.x BETWEEN x0 AND x1 AND p.z BETWEEN z0 AND z1 JOIN edges e USING (pid) GROUP BY p.id, e.pid
  HAVING sum(CASE WHEN (bz > z) <> (az > z) AND x < (ax - bx) * (z - bz) / (CASE WHEN az - bz = 0 THEN 2.220446049250313e-16::DOUBLE ELSE az - bz END) + bx THEN 1 ELSE 0 END) % 2 = 1
), hit AS (
  SELECT id, pid AS primitive, (row_number() OVER (PARTITION BY id ORDER BY ord DESC))::INT AS rank FROM (SELECT * FROM nigh UNION SELECT * FROM within) JOIN prim USING (pid)
)"""
_COS, _SIN = "cos(atan2(50, 100) - 0.25::DOUBLE)", "sin(atan2(50, 100) - 0.25::DOUBLE)"

QUERIES = {
    "point_in_polygon": point_in_polygon, "weights": weights, "spline_samples": spline_samples, "running_length": running_length, "bounds": bounds, "corridors": corridors,
    "tile_prune": tile_prune, "bake_grid": bake_grid, "bake_pyramid": bake_pyramid, "bake_fields": bake_fields, "point_evaluate": point_evaluate, "nearest_anchor": nearest_anchor,
    "nearest_segment": nearest_segment, "primitive_hits": primitive_hits, "cycle_hits": cycle_hits, "transforms": transforms, "anchor_edits": anchor_edits, "type_counts": type_counts,
    "area_fold": area_fold,
}
SQL = {
    "point_in_polygon": f"{_W} SELECT id, pid AS primitive FROM met WHERE type = 'landformArea' AND within",
    "weights": f"{_W} SELECT id, pid AS primitive, round(w, 6) AS w, round(d, 6) AS distance FROM met WHERE w > 0",
    "spline_samples": f"{_S} SELECT pid AS id, j, round(x, 7) AS x, round(z, 7) AS z, seg::INT AS segment FROM pts",
    "running_length": f"""{_S}, l AS (SELECT pid, j, sqrt((bx - ax) ** 2 + (bz - az) ** 2) AS length FROM edges JOIN prim USING (pid) WHERE enabled)
SELECT pid AS id, j AS i, round(length, 6) AS length, round(coalesce(sum(length) OVER (PARTITION BY pid ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start FROM l""",
    "bounds": f"{_S} SELECT pid AS id, round(minx, 7) AS minx, round(maxx, 7) AS maxx, round(minz, 7) AS minz, round(maxz, 7) AS maxz FROM box WHERE enabled",
    "corridors": f"""{_S}, o AS (SELECT p.pid, p.j, p.n, p.x, p.z, c.x - b.x AS dx, c.z - b.z AS dz, width / 2 AS r FROM pts p JOIN prim USING (pid)
  JOIN pts b ON b.pid = p.pid AND b.j = greatest(0, p.j - 1) JOIN pts c ON c.pid = p.pid AND c.j = least(p.n - 1, p.j + 1) WHERE type = 'mountainSpline' AND enabled)
SELECT pid AS id, (CASE WHEN s = 1 THEN j ELSE 2 * n - 1 - j END)::INT AS j, round(x - s * dz / sqrt(dx * dx + dz * dz) * r, 6) AS x, round(z + s * dx / sqrt(dx * dx + dz * dz) * r, 6) AS z FROM o, (VALUES (1), (-1)) v(s)""",
    "tile_prune": f"""{_S}, t AS (SELECT ty, tx, tx * 640.0::DOUBLE - 1280 AS x0, tx * 640.0::DOUBLE - 650 AS x1, ty * 640.0::DOUBLE - 1280 AS z0, ty * 640.0::DOUBLE - 650 AS z1 FROM range(4) a(ty), range(4) b(tx)),
hit AS (SELECT b.pid, b.type, b.pad, t.* FROM box b JOIN t ON maxx >= x0 AND minx <= x1 AND maxz >= z0 AND minz <= z1 WHERE enabled),
s AS (SELECT h.pid, ty, tx, count(*) AS n FROM hit h JOIN edges e USING (pid) WHERE type = 'mountainSpline' AND greatest(ax, bx) + pad >= x0 AND least(ax, bx) - pad <= x1 AND greatest(az, bz) + pad >= z0 AND least(az, bz) - pad <= z1 GROUP BY 1, 2, 3)
SELECT pid AS id, ty::INT AS ty, tx::INT AS tx, -1 AS segments FROM hit WHERE type = 'landformArea' UNION ALL SELECT pid, ty::INT, tx::INT, n::INT FROM s""",
    "bake_grid": f"{_BAKE} SELECT (gy // 64)::INT AS ty, (gx // 64)::INT AS tx, (gy % 64)::INT AS sy, (gx % 64)::INT AS sx, h FROM baked",
    "bake_pyramid": f"""{_BAKE}, l0 AS (SELECT 0 AS d, gy, gx, h FROM baked WHERE h > 0),
l1 AS (SELECT 1 AS d, gy // 2 AS gy, gx // 2 AS gx, floor(sum(h) / 4.0 + 0.5)::INT AS h FROM l0 GROUP BY gy // 2, gx // 2 HAVING floor(sum(h) / 4.0 + 0.5) > 0),
l2 AS (SELECT 2 AS d, gy // 2 AS gy, gx // 2 AS gx, floor(sum(h) / 4.0 + 0.5)::INT AS h FROM l1 GROUP BY gy // 2, gx // 2 HAVING floor(sum(h) / 4.0 + 0.5) > 0)
SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2""",
    "point_evaluate": f"""{_W}, used AS (SELECT * FROM met WHERE w > 0), a AS (
  SELECT id, list_reduce(list_prepend({{'t': 0::DOUBLE, 'w': 0::DOUBLE, 'e': 0::DOUBLE}}, list({{'t': {_TARGET}, 'w': w, 'e': 0::DOUBLE}} ORDER BY priority, ord)),
    lambda a, m: {{'t': 0::DOUBLE, 'w': 0::DOUBLE, 'e': a.e + (m.t - a.e) * m.w}}).e AS e, arg_max(pid, priority * 1e9 + ord) AS landform FROM used WHERE type = 'landformArea' GROUP BY id
), m AS (SELECT id, sum(w * height) AS m FROM used WHERE type = 'mountainSpline' GROUP BY id)
SELECT p.id, round(greatest(0, least({WORLD.height}, coalesce(e, 0) + coalesce(m, 0))), 6) AS elevation, landform, round(coalesce(m, 0), 6) AS mountain FROM points p LEFT JOIN a USING (id) LEFT JOIN m USING (id)""",
    "nearest_anchor": f"""{_S}, {POINTS}, m AS (SELECT p.id, a.pid, a.i, ord, sqrt((p.x - a.x) ** 2 + (p.z - a.z) ** 2) AS d FROM points p JOIN anch a ON a.x BETWEEN p.x - 30 AND p.x + 30 JOIN prim USING (pid)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ord, i) AS rn FROM m WHERE d <= {THRESHOLD}) SELECT id, pid AS primitive, pid || '-' || i AS anchor, round(d, 6) AS distance FROM r WHERE rn = 1""",
    "nearest_segment": f"""{_S}, {POINTS}, {_SEGMENTS}, ok AS (
  SELECT f.*, ord, CASE WHEN smooth <= 0 THEN f.j + 1 ELSE CASE WHEN (aseg + 1) % 4 = 0 THEN 4 ELSE (aseg + 1) % 4 END END AS ins FROM far f JOIN prim USING (pid)
  WHERE enabled AND d <= {max(18.0, THRESHOLD * 0.75)} AND (smooth <= 0 OR aseg = bseg OR (closed AND f.j = f.n - 1))
), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ord DESC, j) AS rn FROM ok)
SELECT id, pid AS primitive, ins::INT AS insert_at, round(d, 6) AS distance FROM r WHERE rn = 1""",
    "primitive_hits": f"{_HITS} SELECT * FROM hit",
    "cycle_hits": f"""{_HITS}, n AS (SELECT id, max(rank) AS n FROM hit GROUP BY id)
SELECT h.id, h.primitive FROM hit h JOIN n USING (id) WHERE rank = CASE WHEN n >= 2 THEN 2 % n + 1 ELSE 1 END""",
    "transforms": f"""{_S}, c AS (SELECT pid, avg(x) AS cx, avg(z) AS cz FROM anch GROUP BY pid)
SELECT pid AS id, i, round(x + 12.5, 6) AS tx, round(z - 7.25, 6) AS tz, round(10 + (x - 10) * {_COS} - (z - 20) * {_SIN}, 6) AS rx, round(20 + (x - 10) * {_SIN} + (z - 20) * {_COS}, 6) AS rz,
       round(cx, 6) AS cx, round(cz, 6) AS cz FROM anch JOIN c USING (pid)""",
    "anchor_edits": f"""{_S}, a AS (SELECT pid, ord, list(pid || '-' || i ORDER BY i) AS l FROM anch JOIN prim USING (pid) GROUP BY pid, ord),
b AS (SELECT pid, l[1:ord % 5] || ['new'] || l[ord % 5 + 1:] AS l FROM a)
SELECT pid AS id, enabled AND pid <> 'area-4' AS enabled, round(CASE WHEN pid = 'area-4' THEN 77 ELSE elevation END, 6) AS elevation,
       array_to_string(CASE WHEN pid = 'area-3' THEN list_filter(l, lambda v: v <> 'area-3-1') ELSE l END, ',') AS anchors FROM b JOIN prim USING (pid) WHERE pid <> 'area-5'""",
    "type_counts": f"{_S} SELECT type, count(*) AS n, count(*) FILTER (WHERE enabled) AS n_enabled FROM prim GROUP BY type",
    "area_fold": """WITH l AS (SELECT c_nationkey, list({'t': greatest(-1e308::DOUBLE, c_acctbal / 10), 'w': (c_custkey % 10) / 10.0::DOUBLE, 'e': 0::FLOAT} ORDER BY c_custkey) AS ms FROM customer GROUP BY 1)
SELECT c_nationkey, list_reduce(list_prepend({'t': 0::DOUBLE, 'w': 0::DOUBLE, 'e': 0::FLOAT}, ms), lambda a, m: {'t': 0::DOUBLE, 'w': 0::DOUBLE, 'e': (a.e::DOUBLE + (m.t - a.e::DOUBLE) * m.w)::FLOAT}).e::DOUBLE AS areas,
  list_reduce(list_prepend({'t': 0::DOUBLE, 'w': 0::DOUBLE, 'e': 0::FLOAT}, ms), lambda a, m: {'t': 0::DOUBLE, 'w': 0::DOUBLE, 'e': greatest(0::DOUBLE, least(1000::DOUBLE, a.e::DOUBLE + 1::DOUBLE * m.t * m.w))::FLOAT}).e::DOUBLE AS splines FROM l""",
}
