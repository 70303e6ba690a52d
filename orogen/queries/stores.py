"""Queries that write to a store below the shared scratch folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import sampling
from ..plans import graph as G
from ..plans import lifecycle
from ..plans.presets import presets
from ..sources import codecs
from ..sources.store import Store
from .inputs import HEIGHTMAP, SIDE, TILE, heightmap, table

CONFIG = {"name": " Made ", "tileSize": 4, "tilesPerSide": 4, "unitSize": 1, "unit": "foot", "worldHeight": 100}


def scratch_store(spark: SparkSession) -> Store:
    """A new store in the folder that driver and executors share; only a local master may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    root = shared.rstrip("/") if shared else f"file://{tempfile.mkdtemp(prefix='orogen-')}"
    return Store(spark, f"{root}/store-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    store = scratch_store(spark)
    store.write_tiles("w", codecs.pack_tiles(heightmap(spark, sf_dir), TILE))
    return store


def store_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heightmap written as tiles and read back."""
    return codecs.unpack_tiles(_stored(spark, sf_dir).read_tiles("w").select("d", "y", "x", "data"), TILE)


def store_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored tile by its key."""
    return codecs.unpack_tiles(_stored(spark, sf_dir).read_tile("w", 1, 2, 0, SIDE).select("d", "y", "x", "data"), TILE)


def store_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heightmap written as raw tile files and read back."""
    store = scratch_store(spark)
    store.write_raw("w", codecs.pack_tiles(heightmap(spark, sf_dir), TILE))
    return codecs.unpack_tiles(store.read_raw("w"), TILE)


def store_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions registered as projects, one of them twice and one deleted."""
    store = scratch_store(spark)
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # five rows
        store.register(f"w{r['r_regionkey']}", r["r_name"], f"2024-01-0{r['r_regionkey'] + 1}")
    store.register("w1", "again", "2024-02-01")
    store.delete("w3")
    return store.projects().select("id", "name", "updatedAt")


def store_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs as stored (older names, water missing) and as read."""
    store, rows = scratch_store(spark), []
    for name, config in (("new", {"worldHeight": 7, "water": {"visible": True, "level": 3}}), ("old", {"maxElevation": 9}), ("none", {"water": {"level": "x"}})):
        store.write_config(name, config)
        read = store.read_config(name)
        rows.append((name, float(read["worldHeight"]), read["water"]["visible"], float(read["water"]["level"])))
    return spark.createDataFrame(rows, "id string, worldHeight double, visible boolean, level double")


def store_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of the nations' primitives, stored and read back; beside a missing and a broken one."""
    store = scratch_store(spark)
    listed = [{"id": f"p{r['n_nationkey']}", "type": "landformArea"} for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    store.write_document("w", {"primitives": listed, "fieldLibrary": [presets()[0]]})
    store.fs.write(store.at("broken", "authoring.json"), "{")
    rows = [(i, d["worldId"], d["version"], len(d["primitives"]), len(d["fieldLibrary"])) for i in ("w", "broken", "missing") for d in [store.read_document(i)]]
    return spark.createDataFrame(rows, "id string, worldId string, version int, primitives int, fields int")


def _levels(store: Store) -> DataFrame:
    samples = codecs.unpack_tiles(store.read_tiles("w").select("d", "y", "x", "data"), CONFIG["tileSize"])
    return samples.groupBy("d").agg(F.count(F.lit(1)).alias("samples"), F.min("h").alias("low"), F.max("h").alias("high"))


def world_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new world's stored levels."""
    store = scratch_store(spark)
    lifecycle.create_world(store, "w", CONFIG)
    return _levels(store)


def world_baked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored levels of a world whose one area covers it at 80 of 100."""
    store = scratch_store(spark)
    lifecycle.create_world(store, "w", CONFIG)
    anchors = [{"id": f"a{i}", "x": x, "z": z} for i, (x, z) in enumerate([(-90, -90), (90, -90), (90, 90), (-90, 90)])]
    saved = lifecycle.bake_project(store, "w", {"primitives": [{"id": "p", "type": "landformArea", "elevation": 80, "anchors": anchors}]})
    bake = saved["lastBake"]
    return _levels(store).withColumns({"status": F.lit(bake["status"]), "tiles": F.lit(bake["tileCount"]).cast("int"), "primitives": F.lit(bake["primitiveCount"]).cast("int")})


def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that suppliers need, without those that nations hold."""
    s = table(spark, sf_dir, "supplier").select(F.lit(0).alias("d"), (F.col("s_suppkey") % 9).cast("int").alias("y"), (F.col("s_suppkey") % 7).cast("int").alias("x"))
    n = table(spark, sf_dir, "nation").select(F.lit(0).alias("d"), (F.col("n_nationkey") % 9).cast("int").alias("y"), (F.col("n_nationkey") % 7).cast("int").alias("x"))
    return sampling.missing_tiles(s, n)


def edited_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' worlds with another height, to which the water follows."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(500.0).alias("worldHeight"), F.struct(F.lit(True).alias("visible"), F.col("c_acctbal").cast("double").alias("level")).alias("water"))
    return D.with_height(c, 300).select("id", "worldHeight", "water.visible", "water.level")


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per region, of its nations' primitives: each counts its own."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), F.struct(F.col("n_nationkey").alias("k"), F.format_string('{"id":"p%d","type":"%s"}', "n_nationkey", F.when(F.col("n_nationkey") % 4 == 3, "castle").otherwise("landformArea")).alias("j")).alias("s"))
    docs = n.groupBy("doc").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return D.normalize_primitives(docs.select("doc", F.concat(F.lit('{"primitives":['), F.array_join(F.transform("l", lambda s: s["j"]), ","), F.lit("]}")).alias("json"))).select("doc", "id", "ord", "type")


def seed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of all built-in noise, one per octave, and their slots."""
    return spark.createDataFrame(list(G.seed_slots(presets()).items()), "seed long, slot long")


def graph_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What editing leaves of the first built-in graph: searched, connected again, without a node, without an edge."""
    g = presets()[0]
    end = {"nodeId": "plains-output", "portId": "value"}
    again = G.connect(g, {"nodeId": "plains-broad-scaled", "portId": "value"}, end)
    none = G.connect(g, {"nodeId": "plains-position", "portId": "xy"}, end)
    fewer = G.delete(g, node_id="plains-sum")
    rows = [("stored", g), ("connected", again), ("without node", fewer), ("without output", G.delete(g, node_id="plains-output")), ("without edge", G.delete(g, edge_id=g["edges"][0]["id"]))]
    out = [(name, len(x["nodes"]), len(x["edges"])) for name, x in rows] + [("refused", 0 if none is None else 1, 0), ("found", len(G.search_nodes(" FBM ")), len(G.search_nodes("output")))]
    return spark.createDataFrame(out, "step string, nodes int, edges int")


_SEEDS = ", ".join(f"({int(n['params'].get('seed', 1))}, {int(n['params'].get('octaves', 5))})" for g in presets() for n in g["nodes"] if n["type"] in ("fbm2d", "ridged2d"))
QUERIES = {
    "store_tiles": store_tiles, "store_tile": store_tile, "store_raw": store_raw, "store_registry": store_registry, "store_config": store_config, "store_document": store_document, "world_created": world_created,
    "world_baked": world_baked, "missing_tiles": missing_tiles, "edited_configs": edited_configs, "normalize_documents": normalize_documents, "seed_slots": seed_slots, "graph_edits": graph_edits,
}
_LEVELS = "SELECT d::INT AS d, (16 * (1 << (4 - 2 * d)))::BIGINT AS samples, {h}::INT AS low, {h}::INT AS high{more} FROM range(3) r(d)"
SQL = {
    "store_tiles": f"WITH {HEIGHTMAP} SELECT * FROM heightmap",
    "store_tile": f"WITH {HEIGHTMAP} SELECT * FROM heightmap WHERE gy // 16 = 2 AND gx // 16 = 1",
    "store_raw": f"WITH {HEIGHTMAP} SELECT * FROM heightmap",
    "store_registry": """SELECT 'w' || r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'again' ELSE r_name END AS name,
  CASE WHEN r_regionkey = 1 THEN '2024-02-01' ELSE '2024-01-0' || (r_regionkey + 1) END AS "updatedAt" FROM region WHERE r_regionkey <> 3""",
    "store_config": """SELECT * FROM (VALUES ('new', 7::DOUBLE, true, 3::DOUBLE), ('old', 9, false, 0), ('none', 1024, false, 0)) t(id, "worldHeight", visible, level)""",
    "store_document": """SELECT 'w' AS id, 'w' AS "worldId", 1 AS version, count(*)::INT AS primitives, 6 AS fields FROM nation
UNION ALL SELECT * FROM (VALUES ('broken', 'broken', 1, 0, 6), ('missing', 'missing', 1, 0, 6))""",
    "world_created": _LEVELS.format(h=0, more=""),
    "world_baked": _LEVELS.format(h=52428, more=", 'clean' AS status, 21::INT AS tiles, 1::INT AS primitives"),
    "missing_tiles": "SELECT DISTINCT 0 AS d, (s_suppkey % 9)::INT AS y, (s_suppkey % 7)::INT AS x FROM supplier WHERE (s_suppkey % 9, s_suppkey % 7) NOT IN (SELECT (n_nationkey % 9, n_nationkey % 7) FROM nation)",
    "edited_configs": 'SELECT c_custkey AS id, 300::DOUBLE AS "worldHeight", true AS visible, greatest(0, least(300, c_acctbal))::DOUBLE AS level FROM customer',
    "normalize_documents": "SELECT n_regionkey AS doc, 'p' || n_nationkey AS id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS ord, 'landformArea' AS type FROM nation WHERE n_nationkey % 4 <> 3",
    "seed_slots": f"WITH n(seed, octaves) AS (VALUES {_SEEDS}), s AS (SELECT DISTINCT seed + 1013 * o AS seed FROM n, range(12) r(o) WHERE o < least(12, greatest(1, octaves))) SELECT seed::BIGINT AS seed, row_number() OVER (ORDER BY seed) - 1 AS slot FROM s",
    "graph_edits": """SELECT * FROM (VALUES ('stored', 9, 9), ('connected', 9, 9), ('without node', 8, 6), ('without output', 9, 9), ('without edge', 9, 8), ('refused', 0, 0), ('found', 1, 0)) t(step, nodes, edges)""",
}
