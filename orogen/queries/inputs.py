"""Terrain inputs derived from the business tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bake import World

#: Heightmap of 64 x 64 samples in tiles of 16.
TILE, SIDE = 16, 4
GRID = World(tile_size=TILE, tiles_per_side=SIDE, unit=1.0, height=1000.0)
#: The world of the derived primitives.
WORLD = World(tile_size=64, tiles_per_side=4, unit=10.0, height=1000.0, water=50.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heightmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, gy, gx, h: prices summed over a grid of part and supplier keys, absent cells 0."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint")
    sums = rows.groupBy((F.col("l_suppkey") % 64).cast("int").alias("gy"), (F.col("l_partkey") % 64).cast("int").alias("gx")).agg((F.sum(cents) % 65536).cast("int").alias("h"))
    grid = spark.range(64 * 64).select(F.expr("cast(id div 64 as int)").alias("gy"), F.expr("cast(id % 64 as int)").alias("gx"))
    return grid.join(sums, ["gy", "gx"], "left").select(F.lit(0).alias("d"), "gy", "gx", F.coalesce("h", F.lit(0)).alias("h"))


HEIGHTMAP = """
sums AS (
  SELECT (l_suppkey % 64)::INT AS gy, (l_partkey % 64)::INT AS gx, (sum(floor(l_extendedprice * 100 + 0.5)::BIGINT) % 65536)::INT AS h FROM lineitem GROUP BY 1, 2
), heightmap AS (
  SELECT 0 AS d, y.gy::INT AS gy, x.gx::INT AS gx, coalesce(h, 0) AS h FROM range(64) y(gy) CROSS JOIN range(64) x(gx) LEFT JOIN sums ON sums.gy = y.gy AND sums.gx = x.gx
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, z: one place per customer, inside and outside of the derived world."""
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 2700 - 1350 + 0.25).cast("double").alias("x"), (F.col("c_custkey") * 101 % 2700 - 1350 + 0.5).cast("double").alias("z"))


POINTS = "points AS (SELECT c_custkey AS id, (c_custkey * 37 % 2700 - 1350 + 0.25)::DOUBLE AS x, (c_custkey * 101 % 2700 - 1350 + 0.5)::DOUBLE AS z FROM customer)"


def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An area of four anchors for every supplier, a spline of four for every nation; some are disabled, some unsmoothed."""
    s = table(spark, sf_dir, "supplier")
    cx, cz = F.col("k") * 389 % 2400 - 1200, F.col("k") * 997 % 2400 - 1200
    size = 60 + F.col("k") % 90
    around = [(-1, 0), (0, -1), (1, 0), (0, 1)]

    def anchor(i: int, x, z):
        return F.struct(F.format_string(f"%s-{i}", "id").alias("id"), x.cast("double").alias("x"), z.cast("double").alias("z"))

    none = F.lit(None).cast("double")
    areas = s.select(F.col("s_suppkey").alias("k"), F.format_string("area-%d", "s_suppkey").alias("id"), (F.col("s_acctbal") / 16).alias("elevation"))
    areas = areas.select(
        "id", F.col("k").cast("int").alias("ord"), F.lit("landformArea").alias("type"), (F.col("k") % 11 != 0).alias("enabled"),
        F.when(F.col("k") % 7 == 0, "water").when(F.col("k") % 7 == 1, "plateau").otherwise("land").alias("mode"), "elevation", F.lit(0.0).alias("noiseScale"),
        (F.col("k") % 3).cast("double").alias("priority"), none.alias("height"), none.alias("width"), F.lit(None).cast("string").alias("fieldId"),
        (F.col("k") % 4 * 12).cast("double").alias("edgeSmoothness"), F.when(F.col("k") % 2 == 0, 0.65).otherwise(0.0).alias("splineSmoothness"),
        F.array(*[anchor(i, cx + dx * size, cz + dz * size) for i, (dx, dz) in enumerate(around)]).alias("anchors"),
    )
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.format_string("spline-%d", "n_nationkey").alias("id"))
    path = [(-300, -40), (-100, 60), (100, -60), (300, 40)]
    sx, sz = F.col("k") * 211 % 1600 - 800, F.col("k") * 577 % 2000 - 1000
    splines = n.select(
        "id", (F.col("k") + 1000000).cast("int").alias("ord"), F.lit("mountainSpline").alias("type"), (F.col("k") % 6 != 5).alias("enabled"), F.lit(None).cast("string").alias("mode"),
        none.alias("elevation"), none.alias("noiseScale"), none.alias("priority"), (F.col("k") % 5 * 60).cast("double").alias("height"), (80 + F.col("k") % 3 * 20).cast("double").alias("width"),
        F.lit(None).cast("string").alias("fieldId"), (F.col("k") % 3 * 15).cast("double").alias("edgeSmoothness"), F.when(F.col("k") % 2 == 0, 1.0).otherwise(0.0).alias("splineSmoothness"),
        F.array(*[anchor(i, sx + dx, sz + dz) for i, (dx, dz) in enumerate(path)]).alias("anchors"),
    )
    return areas.unionByName(splines)


#: prim and anch, then the smoothed outline pts (pid, j, x, z, seg), its edges and each primitive's box.
SHAPES = """
prim AS (
  SELECT 'area-' || s_suppkey AS pid, s_suppkey::INT AS ord, 'landformArea' AS type, s_suppkey % 11 <> 0 AS enabled,
         CASE WHEN s_suppkey % 7 = 0 THEN 'water' WHEN s_suppkey % 7 = 1 THEN 'plateau' ELSE 'land' END AS mode, s_acctbal / 16 AS elevation, (s_suppkey % 3)::DOUBLE AS priority,
         NULL::DOUBLE AS height, NULL::DOUBLE AS width, (s_suppkey % 4 * 12)::DOUBLE AS edge, CASE WHEN s_suppkey % 2 = 0 THEN 0.65::DOUBLE ELSE 0::DOUBLE END AS smooth, s_suppkey AS k FROM supplier
  UNION ALL
  SELECT 'spline-' || n_nationkey, n_nationkey + 1000000, 'mountainSpline', n_nationkey % 6 <> 5, NULL, NULL, NULL, (n_nationkey % 5 * 60)::DOUBLE, (80 + n_nationkey % 3 * 20)::DOUBLE,
         (n_nationkey % 3 * 15)::DOUBLE, CASE WHEN n_nationkey % 2 = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END, n_nationkey FROM nation
), anch AS (
  SELECT pid, i, (k * 389 % 2400 - 1200 + dx * (60 + k % 90))::DOUBLE AS x, (k * 997 % 2400 - 1200 + dz * (60 + k % 90))::DOUBLE AS z
  FROM prim, (VALUES (0, -1, 0), (1, 0, -1), (2, 1, 0), (3, 0, 1)) v(i, dx, dz) WHERE type = 'landformArea'
  UNION ALL
  SELECT pid, i, (k * 211 % 1600 - 800 + dx)::DOUBLE, (k * 577 % 2000 - 1000 + dz)::DOUBLE
  FROM prim, (VALUES (0, -300, -40), (1, -100, 60), (2, 100, -60), (3, 300, 40)) v(i, dx, dz) WHERE type = 'mountainSpline'
), seg AS (
  SELECT p.pid, b.i, type = 'landformArea' AS closed, smooth, a.x AS x0, a.z AS z0, b.x AS x1, b.z AS z1, c.x AS x2, c.z AS z2, d.x AS x3, d.z AS z3,
         greatest(4, ceil(sqrt((c.x - b.x) ** 2 + (c.z - b.z) ** 2) / 80))::INT AS steps
  FROM prim p JOIN anch b ON b.pid = p.pid AND (type = 'landformArea' OR b.i < 3)
  JOIN anch a ON a.pid = p.pid AND a.i = CASE WHEN type = 'landformArea' THEN (b.i + 3) % 4 ELSE greatest(0, b.i - 1) END
  JOIN anch c ON c.pid = p.pid AND c.i = CASE WHEN type = 'landformArea' THEN (b.i + 1) % 4 ELSE least(3, b.i + 1) END
  JOIN anch d ON d.pid = p.pid AND d.i = CASE WHEN type = 'landformArea' THEN (b.i + 2) % 4 ELSE least(3, b.i + 2) END
), curve AS (
  SELECT *, k::DOUBLE / steps AS t FROM (SELECT *, unnest(range(CASE WHEN i > 0 THEN 1 ELSE 0 END, steps)) AS k FROM seg WHERE smooth > 0)
), drawn AS (
  SELECT pid, i, k, x1 + (x2 - x1) * t + (0.5 * (2 * x1 + (x2 - x0) * t + (2 * x0 - 5 * x1 + 4 * x2 - x3) * t * t + (3 * x1 - x0 - 3 * x2 + x3) * t * t * t) - (x1 + (x2 - x1) * t)) * smooth AS x,
         z1 + (z2 - z1) * t + (0.5 * (2 * z1 + (z2 - z0) * t + (2 * z0 - 5 * z1 + 4 * z2 - z3) * t * t + (3 * z1 - z0 - 3 * z2 + z3) * t * t * t) - (z1 + (z2 - z1) * t)) * smooth AS z, i AS seg FROM curve
  UNION ALL
  SELECT a.pid, 3, 0, a.x, a.z, 2 FROM anch a JOIN prim p USING (pid) WHERE smooth > 0 AND type = 'mountainSpline' AND a.i = 3
  UNION ALL
  SELECT a.pid, a.i, 0, a.x, a.z, CASE WHEN type = 'landformArea' THEN a.i ELSE least(a.i, 2) END FROM anch a JOIN prim p USING (pid) WHERE smooth <= 0
), pts AS (
  SELECT pid, (row_number() OVER (PARTITION BY pid ORDER BY i, k) - 1)::INT AS j, x, z, seg, count(*) OVER (PARTITION BY pid) AS n FROM drawn
), edges AS (
  SELECT a.pid, a.j, type = 'landformArea' AS closed, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz, a.seg AS aseg, b.seg AS bseg, a.n
  FROM pts a JOIN prim p USING (pid) JOIN pts b ON b.pid = a.pid AND b.j = (a.j + 1) % a.n WHERE type = 'landformArea' OR a.j < a.n - 1
), box AS (
  SELECT p.*, x0 - pad AS minx, x1 + pad AS maxx, z0 - pad AS minz, z1 + pad AS maxz
  FROM (SELECT *, CASE WHEN type = 'landformArea' THEN 0 ELSE width / 2 END AS pad FROM prim) p JOIN (SELECT pid, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM pts GROUP BY pid) USING (pid)
)"""


def weights_sql(source: str) -> str:
    """met: rows of `source` (id, x, z) beside the enabled primitives whose box holds them, with the distance d, inside, and the weight w."""
    return f"""
near AS (
  SELECT s.id, s.x, s.z, b.* FROM {source} s JOIN box b ON b.enabled AND s.x BETWEEN minx AND maxx AND s.z BETWEEN minz AND maxz
), span AS (
  SELECT n.id, n.x, n.z, n.pid, e.*, (bx - ax) * (bx - ax) + (bz - az) * (bz - az) AS l2 FROM near n JOIN (SELECT pid AS epid, * EXCLUDE (pid) FROM edges) e ON e.epid = n.pid
), part AS (
  SELECT *, CASE WHEN l2 = 0 THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, ((x - ax) * (bx - ax) + (z - az) * (bz - az)) / l2)) END AS t FROM span
), far AS (
  SELECT id, pid, sqrt(min((x - (ax + (bx - ax) * t)) * (x - (ax + (bx - ax) * t)) + (z - (az + (bz - az) * t)) * (z - (az + (bz - az) * t)))) AS d,
         sum(CASE WHEN (bz > z) <> (az > z) AND x < (ax - bx) * (z - bz) / (CASE WHEN az - bz = 0 THEN 2.220446049250313e-16::DOUBLE ELSE az - bz END) + bx THEN 1 ELSE 0 END) % 2 = 1 AS within
  FROM part GROUP BY id, pid
), ramp AS (
  SELECT n.*, f.d, f.within, width / 2 AS half, greatest(0::DOUBLE, least(width / 2, edge)) AS soft FROM near n JOIN far f USING (id, pid)
), met AS (
  SELECT *, CASE WHEN type = 'landformArea' THEN
    CASE WHEN NOT within THEN 0::DOUBLE WHEN edge <= 0 THEN 1::DOUBLE WHEN d > edge THEN 1::DOUBLE
         ELSE greatest(0::DOUBLE, least(1::DOUBLE, d / edge)) * greatest(0::DOUBLE, least(1::DOUBLE, d / edge)) * (3 - 2 * greatest(0::DOUBLE, least(1::DOUBLE, d / edge))) END
  ELSE
    CASE WHEN d >= half THEN 0::DOUBLE WHEN soft = 0 THEN 1 - d / half WHEN d <= greatest(0, half - soft) THEN 1::DOUBLE
         ELSE 1 - ((d - (half - soft)) / (half - (half - soft))) * ((d - (half - soft)) / (half - (half - soft))) * (3 - 2 * ((d - (half - soft)) / (half - (half - soft)))) END
  END AS w FROM ramp
)"""
