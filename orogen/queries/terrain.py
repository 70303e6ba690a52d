"""Heightmaps, pyramids, keys, points and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import scalars as S
from ..operators import pyramid as P
from ..operators import sampling as V
from .inputs import GRID, HEIGHTMAP, SIDE, TILE, WORLD, heightmap, points, table

LEVELS = 6


def heightmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heightmap(spark, sf_dir)


def lod_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pyramid(heightmap(spark, sf_dir), LEVELS)


def _levels_sql(levels: int) -> str:
    out = ["l0 AS (SELECT * FROM heightmap)"]
    out += [f"l{k} AS (SELECT {k} AS d, gy // 2 AS gy, gx // 2 AS gx, floor(sum(h) / 4.0 + 0.5)::INT AS h FROM l{k - 1} GROUP BY gy // 2, gx // 2)" for k in range(1, levels + 1)]
    return ", ".join(out) + ", pyramid AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(levels + 1)) + ")"


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of depth 0 that events touch; users stand for places."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.expr(f"cast(user_id % {SIDE} as int)").alias("x"), F.expr("cast(user_id % 3 as int)").alias("y"))
    return rows.distinct().withColumn("d", F.lit(0))


_DIRTY = f"dirty AS (SELECT DISTINCT (user_id % {SIDE})::INT AS x, (user_id % 3)::INT AS y, 0 AS d FROM events WHERE event_type = 'purchase')"


def lod_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = P.pyramid(heightmap(spark, sf_dir), 2)
    return P.rebuild_dirty(stored, _dirty(spark, sf_dir), TILE, SIDE)


def dirty_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ancestors(_dirty(spark, sf_dir), SIDE)


_ANCESTORS = "anc AS (SELECT DISTINCT (x >> k)::INT AS x, (y >> k)::INT AS y, (d + k)::INT AS d FROM dirty, range(1, 3) r(k))"


def usable_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heightmap(spark, sf_dir).withColumn("ty", F.expr(f"cast(gy div {TILE} as int)")).withColumn("tx", F.expr(f"cast(gx div {TILE} as int)"))
    return P.usable_range(rows, ["ty", "tx"])


def tile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).cast("int").alias("x"), (F.col("o_custkey") % 8).cast("int").alias("y"), F.lit(0).alias("d")).distinct()
    x, y, d = (F.col(c) for c in "xyd")
    px, py, pd_ = K.parent(x, y, d)
    first = F.get(K.children(px, py, pd_), F.lit(3))
    return k.select(
        "x", "y", K.tile_id(x, y, d).alias("id"), K.tile_path(x, y, d, "png").alias("path"), K.tile_number(x, y, d).alias("number"), px.alias("px"), py.alias("py"), pd_.alias("pd"),
        first["x"].alias("se_x"), first["y"].alias("se_y"), K.tiles_at(F.lit(8), d + 1).alias("side"), K.valid_key(x, y, d + 1, 8).alias("valid_above"), K.lod_tile_count(F.lit(8)).alias("above"),
    )


def world_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    unit = F.element_at(F.array(F.lit("foot"), F.lit("meter"), F.lit("cm")), (F.col("p_partkey") % 3 + 1).cast("int"))
    size, side = F.pow(F.lit(2.0), F.col("p_size") % 12), (F.col("p_partkey") % 40)
    scale = F.col("p_retailprice") / 1000
    return p.select(
        "p_partkey", F.round(K.linear_size(size, side, scale), 6).alias("linear"), F.round(K.area_square_miles(size, side, scale, unit), 6).alias("miles"),
        F.round(K.meters_to_units(scale, unit), 6).alias("units"), K.is_power_of_two(side).alias("power"), K.to_sample(F.col("p_retailprice"), 2000.0).alias("sample"),
    )


def hash_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", S.hash2(F.col("user_id") - 500, -F.col("event_id"), 42).alias("hash"))


def _mul(a: str, b: int) -> str:
    b &= S.U32
    return f"((((({a}) & 65535) * {b}) + ((((({a}) >> 16) * {b}) & 65535) * 65536)) & 4294967295)"


def _hash_sql(x: str, y: str, seed: int, tag: str = "h") -> tuple[str, str]:
    """Two nested selects would repeat the text; so the mix is given in steps: inner value and the final expression of it."""
    inner = f"xor(xor({_mul(f'({x}) & 4294967295', 374761393)}, {_mul(f'({y}) & 4294967295', 668265263)}), {(seed * 1442695041) & S.U32})"
    mixed = _mul(f"xor({tag}, {tag} >> 13)", 1274126177)
    return inner, mixed


_H, _M = _hash_sql("user_id - 500", "-event_id", 42)


def value_noise_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The procedural tile: heights of a 64 x 64 grid, quantized."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    grid = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(255)))).select((F.col("k") * 16 + F.col("i") % 16).alias("x"), F.expr("cast(i div 16 as int)").alias("y"))
    return grid.select("x", "y", S.half_up(S.rolling_height(F.col("x").cast("double"), F.col("y").cast("double")) * 65535).cast("int").alias("h"))


def point_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", (F.col("x") / 40).alias("x"), (F.col("z") / 40).alias("z"))
    return V.heights_at(p, heightmap(spark, sf_dir), GRID).select("id", F.round("height", 6).alias("height"))


def chunk_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spark.range(16).select((F.col("id") % 2).cast("int").alias("lod"), F.expr("cast(id div 8 as int)").alias("cy"), F.expr("cast((id div 2) % 4 as int)").alias("cx"))
    return _meshed(spark, sf_dir, chunks.where("lod = 0 or (cy < 1 and cx < 2)"))


def chunk_mesh_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of the heightmap: 16 at lod 0, 4 at lod 1 and 1 at lod 2. chunk_mesh takes the part that its SQL has."""
    side = F.expr(f"cast({SIDE} >> lod as int)")
    chunks = spark.range(3).select(F.col("id").cast("int").alias("lod"))
    chunks = chunks.withColumn("cy", F.explode(F.sequence(F.lit(0), side - 1))).withColumn("cx", F.explode(F.sequence(F.lit(0), side - 1)))
    return _meshed(spark, sf_dir, chunks)


def _meshed(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    out = V.chunk_mesh(chunks, P.pyramid(heightmap(spark, sf_dir), 2), GRID, segments=16)
    return out.select("lod", "cy", "cx", "vy", "vx", *[F.round(c, 6).alias(c) for c in ("height", "r", "g", "b", "nx", "ny", "nz", "radius")])


def _mesh_sql() -> str:
    n, half = 16, 8
    color = {k: [int(c[i : i + 2], 16) / 255 for c in ("173824", "5aa36e", "e4f6bc")] for k, i in (("r", 0), ("g", 2), ("b", 4))}
    ramp = ", ".join(f"round(CASE WHEN t < 0.62 THEN {a}::DOUBLE + {b - a}::DOUBLE * (t / 0.62::DOUBLE) ELSE {b}::DOUBLE + {c - b}::DOUBLE * ((t - 0.62::DOUBLE) / 0.38::DOUBLE) END, 6) AS {k}" for k, (a, b, c) in color.items())
    return f"""WITH {HEIGHTMAP}, {_levels_sql(2)}, chunks AS (
  SELECT (id % 2)::INT AS lod, (id // 8)::INT AS cy, ((id // 2) % 4)::INT AS cx FROM range(16) r(id)
), grid AS (
  SELECT lod, cy, cx, vy, vx, greatest(0, least(64 // (1 << lod) - 1, cx * {n} + vx)) AS gx, greatest(0, least(64 // (1 << lod) - 1, cy * {n} + vy)) AS gy
  FROM chunks, range(-1, {n + 2}) a(vy), range(-1, {n + 2}) b(vx) WHERE lod = 0 OR (cy < 1 AND cx < 2)
), raw AS (
  SELECT g.*, h AS raw, h / 65535.0::DOUBLE * 1000 AS height FROM grid g JOIN pyramid p ON p.d = g.lod AND p.gy = g.gy AND p.gx = g.gx
), sl AS (
  SELECT *, lag(height) OVER rw - lead(height) OVER rw AS sx, lag(height) OVER cl - lead(height) OVER cl AS sz FROM raw
  WINDOW rw AS (PARTITION BY lod, cy, cx, vy ORDER BY vx), cl AS (PARTITION BY lod, cy, cx, vx ORDER BY vy)
), mid AS (
  SELECT *, raw / 65535.0::DOUBLE AS t, sqrt(sx * sx + 4 + sz * sz) AS len FROM sl WHERE vx BETWEEN 0 AND {n} AND vy BETWEEN 0 AND {n}
)
SELECT lod, cy, cx, vy::INT AS vy, vx::INT AS vx, round(height, 6) AS height, {ramp}, round(sx / len, 6) AS nx, round(2 / len, 6) AS ny, round(sz / len, 6) AS nz,
       round(sqrt(max((vx - {half}) * (vx - {half}) + height * height + (vy - {half}) * (vy - {half})) OVER (PARTITION BY lod, cy, cx)), 6) AS radius FROM mid"""


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = V.World(tile_size=64, tiles_per_side=16, unit=2.0)
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("lod"), (F.col("o_custkey") % 16).cast("int").alias("a"), (F.col("o_orderkey") % 7).cast("int").alias("b"))
    side = F.expr("shiftright(16, lod)")
    chunks = rows.select("lod", (F.col("a") % side).alias("cy"), (F.col("b") % side).alias("cx")).distinct()
    return V.chunk_tiles(chunks, world).select("lod", "cy", "cx", "d", "y", "x")


CAMERAS = [V.Camera(310.0, -220.0, 900.0, visible=(700.0, 500.0)), V.Camera(-900.0, 400.0, 800.0, fov=55.0), V.Camera(20.0, 30.0, 800.0, fov=55.0, mode="character")]
VIEW = V.World(tile_size=64, tiles_per_side=32, unit=1.0)


def quadtree_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [V.select_chunks(spark, c, VIEW).withColumn("camera", F.lit(i)) for i, c in enumerate(CAMERAS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _select_sql(camera: V.Camera, i: int) -> str:
    from math import radians, tan

    if camera.visible:
        w, h = camera.visible
        seen = f"minx + size >= {camera.x - w / 2} - size * 0.15 AND minx <= {camera.x + w / 2} + size * 0.15 AND minz + size >= {camera.z - h / 2} - size * 0.15 AND minz <= {camera.z + h / 2} + size * 0.15"
        split = f"size / {h} * {camera.viewport} > 620"
    else:
        gap = lambda lo, v: f"greatest({lo} - ({v}), ({v}) - ({lo} + size), 0)"
        away = f"greatest(1, sqrt({gap('minx', camera.x)} ** 2 + {gap('minz', camera.z)} ** 2))"
        near, far = V.SPLIT_NEAR_FAR[camera.mode]
        seen = "true"
        split = f"size / greatest(1, {away} * {2 * tan(radians(camera.fov) / 2)!r}::DOUBLE) * {camera.viewport} > CASE WHEN {away} < 2048 * 0.42 THEN {near} ELSE {far} END"
    return f"""t{i} AS (
  SELECT 5 AS lod, 0 AS cy, 0 AS cx
  UNION ALL
  SELECT c.lod - 1, c.cy * 2 + j, c.cx * 2 + i FROM (SELECT *, (1 << lod) * 64.0::DOUBLE AS size, cx * (1 << lod) * 64.0::DOUBLE - 1024 AS minx, cy * (1 << lod) * 64.0::DOUBLE - 1024 AS minz FROM t{i}) c,
    (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(j, i) WHERE lod > 0 AND ({seen}) AND ({split})
), s{i} AS (
  SELECT * FROM (SELECT *, (1 << lod) * 64.0::DOUBLE AS size, cx * (1 << lod) * 64.0::DOUBLE - 1024 AS minx, cy * (1 << lod) * 64.0::DOUBLE - 1024 AS minz FROM t{i}) WHERE ({seen}) AND NOT (lod > 0 AND ({split}))
)"""


def selection_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.selection_change(V.select_chunks(spark, CAMERAS[1], VIEW), V.select_chunks(spark, CAMERAS[2], VIEW))


def selection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.selection_totals(V.select_chunks(spark, CAMERAS[1], VIEW))


_SELECT = "WITH RECURSIVE " + ", ".join(_select_sql(c, i) for i, c in enumerate(CAMERAS))
_MILES = "CASE unit WHEN 'foot' THEN 1.0::DOUBLE WHEN 'meter' THEN 3.280839895::DOUBLE ELSE 0.03280839895::DOUBLE END"


def _noise_sql() -> str:
    """Corner hashes per octave as rows, then the blend."""
    octaves = ", ".join(f"({k}, {0.62 * 0.5**k!r}::DOUBLE, {0.0032 * 2**k!r}::DOUBLE, {((42 + 101 * k) * 1442695041) & S.U32})" for k in range(5))
    mixed = _mul("xor(h0, h0 >> 13)", 1274126177)
    return f"""WITH g AS (SELECT n_nationkey * 16 + i % 16 AS x, (i // 16)::INT AS y FROM nation, range(256) r(i)),
c AS (SELECT g.x, g.y, k, amp, seed, floor(g.x * f)::BIGINT AS xi, floor(g.y * f)::BIGINT AS yi, g.x * f - floor(g.x * f) AS fx, g.y * f - floor(g.y * f) AS fy
      FROM g, (VALUES {octaves}) o(k, amp, f, seed)),
q AS (SELECT *, xor(xor({_mul('xi + a', 374761393)}, {_mul('yi + b', 668265263)}), seed) AS h0 FROM c, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) v(a, b)),
m AS (SELECT *, {mixed} AS h1 FROM q),
v AS (SELECT x, y, k, amp, fx * fx * (3 - 2 * fx) AS tx, fy * fy * (3 - 2 * fy) AS ty,
      max(CASE WHEN a = 0 AND b = 0 THEN xor(h1, h1 >> 16) / 4294967295.0::DOUBLE END) AS v00, max(CASE WHEN a = 1 AND b = 0 THEN xor(h1, h1 >> 16) / 4294967295.0::DOUBLE END) AS v10,
      max(CASE WHEN a = 0 AND b = 1 THEN xor(h1, h1 >> 16) / 4294967295.0::DOUBLE END) AS v01, max(CASE WHEN a = 1 AND b = 1 THEN xor(h1, h1 >> 16) / 4294967295.0::DOUBLE END) AS v11
      FROM m GROUP BY x, y, k, amp, fx, fy),
w AS (SELECT x, y, sum(((v00 + (v10 - v00) * tx) + ((v01 + (v11 - v01) * tx) - (v00 + (v10 - v00) * tx)) * ty) * amp ORDER BY k) / {sum(0.62 * 0.5**k for k in range(5))!r}::DOUBLE AS n FROM v GROUP BY x, y)
SELECT x::INT AS x, y, floor(greatest(0, least(1, n * 0.86 + 0.07)) * 65535 + 0.5)::INT AS h FROM w"""


QUERIES = {
    "heightmap_grid": heightmap_grid, "lod_pyramid": lod_pyramid, "lod_dirty": lod_dirty, "dirty_ancestors": dirty_ancestors, "usable_tiles": usable_tiles, "tile_keys": tile_keys,
    "world_units": world_units, "hash_points": hash_points, "value_noise_tile": value_noise_tile, "point_heights": point_heights, "chunk_mesh": chunk_mesh, "chunk_mesh_whole": chunk_mesh_whole, "chunk_plan": chunk_plan,
    "quadtree_select": quadtree_select, "selection_change": selection_change, "selection_totals": selection_totals,
}
SQL = {
    "heightmap_grid": f"WITH {HEIGHTMAP} SELECT * FROM heightmap",
    "lod_pyramid": f"WITH {HEIGHTMAP}, {_levels_sql(LEVELS)} SELECT * FROM pyramid",
    "lod_dirty": f"WITH {HEIGHTMAP}, {_levels_sql(2)}, {_DIRTY}, {_ANCESTORS} SELECT p.* FROM pyramid p JOIN anc ON p.d = anc.d AND p.gx // {TILE} = anc.x AND p.gy // {TILE} = anc.y",
    "dirty_ancestors": f"WITH {_DIRTY}, {_ANCESTORS} SELECT * FROM anc",
    "usable_tiles": f"WITH {HEIGHTMAP} SELECT gy // {TILE} AS ty, gx // {TILE} AS tx, max(h) - min(h) > 64 AS usable FROM heightmap GROUP BY 1, 2",
    "tile_keys": """WITH k AS (SELECT DISTINCT (o_orderkey % 8)::INT AS x, (o_custkey % 8)::INT AS y FROM orders)
SELECT x, y, 'd0/y' || y || '/x' || x AS id, 'tiles/d0/y' || y || '/x' || x || '.png' AS path, y::BIGINT * 32768 + x AS number, x // 2 AS px, y // 2 AS py, 1 AS pd,
       x // 2 * 2 + 1 AS se_x, y // 2 * 2 + 1 AS se_y, 4 AS side, x < 4 AND y < 4 AS valid_above, 21::BIGINT AS above FROM k""",
    "world_units": f"""WITH p AS (SELECT p_partkey, p_retailprice, p_retailprice / 1000 AS scale, (1 << (p_size % 12)) AS size, p_partkey % 40 AS side, ['foot', 'meter', 'cm'][p_partkey % 3 + 1] AS unit FROM part)
SELECT p_partkey, round(size::DOUBLE * side * scale, 6) AS linear, round((size::DOUBLE * side * scale * {_MILES} / 5280) ** 2, 6) AS miles,
       round(scale * CASE unit WHEN 'foot' THEN 3.280839895::DOUBLE WHEN 'meter' THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END, 6) AS units, side IN (1, 2, 4, 8, 16, 32) AS power,
       floor(greatest(0, least(2000, p_retailprice)) / 2000.0::DOUBLE * 65535 + 0.5)::INT AS sample FROM p""",
    "hash_points": f"WITH a AS (SELECT event_id, {_H} AS h FROM events), b AS (SELECT event_id, {_M} AS m FROM a) SELECT event_id, xor(m, m >> 16) / 4294967295.0::DOUBLE AS hash FROM b",
    "value_noise_tile": _noise_sql(),
    "point_heights": f"""WITH {HEIGHTMAP}, p AS (SELECT c_custkey AS id, (c_custkey * 37 % 2700 - 1350 + 0.25)::DOUBLE / 40 + 32 AS lx, (c_custkey * 101 % 2700 - 1350 + 0.5)::DOUBLE / 40 + 32 AS lz FROM customer),
q AS (SELECT id, lx BETWEEN 0 AND 64 AND lz BETWEEN 0 AND 64 AS ok, least(62.999::DOUBLE, lx) AS px, least(62.999::DOUBLE, lz) AS py FROM p),
r AS (SELECT *, floor(px / 16)::INT * 16 AS ox, floor(py / 16)::INT * 16 AS oy FROM q WHERE ok),
t AS (SELECT *, floor(px - ox)::INT AS ix, floor(py - oy)::INT AS iy FROM r),
u AS (SELECT t.id, px - ox - ix AS tx, py - oy - iy AS ty, a.h AS h00, b.h AS h10, c.h AS h01, d.h AS h11 FROM t
  JOIN heightmap a ON a.gy = oy + iy AND a.gx = ox + ix JOIN heightmap b ON b.gy = oy + iy AND b.gx = ox + least(15, ix + 1)
  JOIN heightmap c ON c.gy = oy + least(15, iy + 1) AND c.gx = ox + ix JOIN heightmap d ON d.gy = oy + least(15, iy + 1) AND d.gx = ox + least(15, ix + 1))
SELECT q.id, round(((h00 + (h10 - h00) * tx) + ((h01 + (h11 - h01) * tx) - (h00 + (h10 - h00) * tx)) * ty) / 65535.0::DOUBLE * 1000, 6) AS height FROM q LEFT JOIN u USING (id)""",
    "chunk_mesh": _mesh_sql(),
    "chunk_plan": """WITH c AS (SELECT DISTINCT (o_orderkey % 4)::INT AS lod, ((o_custkey % 16) % (16 >> (o_orderkey % 4)::INT))::INT AS cy, ((o_orderkey % 7) % (16 >> (o_orderkey % 4)::INT))::INT AS cx FROM orders),
s AS (SELECT *, 1 << lod AS st, 1024 // (1 << lod) AS side, (16 >> lod) - 1 AS last FROM c),
r AS (SELECT *, least(last, greatest(0, least(side - 1, cx * 64 - 1)) // 64) AS x0, least(last, greatest(0, least(side - 1, cx * 64 + 65)) // 64) AS x1,
             least(last, greatest(0, least(side - 1, cy * 64 - 1)) // 64) AS y0, least(last, greatest(0, least(side - 1, cy * 64 + 65)) // 64) AS y1 FROM s),
w AS (SELECT lod, cy, cx, x1, x0, unnest(range(y0, y1 + 1)) AS y FROM r)
SELECT lod, cy, cx, lod AS d, y::INT AS y, unnest(range(x0, x1 + 1))::INT AS x FROM w""",
    "quadtree_select": f"{_SELECT} SELECT lod, cy, cx, 0 AS camera FROM s0 UNION ALL SELECT lod, cy, cx, 1 FROM s1 UNION ALL SELECT lod, cy, cx, 2 FROM s2",
    "selection_change": f"""{_SELECT} SELECT coalesce(a.lod, b.lod) AS lod, coalesce(a.cy, b.cy) AS cy, coalesce(a.cx, b.cx) AS cx,
  CASE WHEN a.lod IS NULL THEN 'build' WHEN b.lod IS NULL THEN 'release' ELSE 'keep' END AS action FROM s1 a FULL JOIN s2 b ON a.lod = b.lod AND a.cy = b.cy AND a.cx = b.cx""",
    "selection_totals": f"{_SELECT} SELECT count(*) AS tiles, count(*) * 4225 AS vertices, count(*) * 8192 AS triangles FROM s1",
}
