"""Configs, documents, graphs, fields, codecs and edits."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import documents as D
from ..operators import editing as E
from ..plans import graph as G
from ..plans.presets import PRESETS, presets
from ..sources import codecs, store
from ..streaming import edits as T
from .inputs import HEIGHTMAP, SHAPES, TILE, heightmap, primitives, table


def validate_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("p_name")).alias("name"), F.col("p_size").cast("double").alias("tileSize"),
        (F.col("p_retailprice") - 950).alias("unitSize"), (F.col("p_partkey") % 33).cast("double").alias("tilesPerSide"), (F.col("p_partkey") % 5).cast("double").alias("worldHeight"),
    )
    return p.select("id", F.array_join(D.config_errors(), "|").alias("errors"))


def normalize_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    height = F.when(k % 3 == 0, F.format_string('"worldHeight":%d,', k)).when(k % 3 == 1, F.format_string('"maxElevation":%d,', k)).otherwise("")
    water = F.when(k % 2 == 0, F.format_string('"water":{"visible":true,"level":%d},', k % 50)).otherwise("")
    return D.normalize_configs(c.select(F.concat(F.lit("{"), height, water, F.format_string('"id":"w%d"}', k)).alias("json")))


def normalize_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document over all nations: numbers as text, bad anchors, unknown types."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    kind = F.when(k % 4 == 0, "mountainSpline").when(k % 4 == 3, "castle").otherwise("landformArea")
    one = F.format_string(
        '{"id":"p%d","type":"%s","name":"%s","elevation":"%d","edgeSmoothness":%d,"splineSmoothness":"%d","priority":"x","width":-3,"mode":"%s","enabled":%s,"anchors":[{"id":"a","x":%d,"z":"2"},{"id":"b","x":"no","z":1}]}',
        k, kind, F.when(k % 5 == 0, " ").otherwise(F.col("n_name")), k * 10, k - 12, k % 3, F.when(k % 2 == 0, "water").otherwise("lava"), F.when(k % 6 == 0, "false").otherwise("true"), k,
    )
    doc = n.select(F.struct(k.alias("k"), one.alias("j")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("l"))
    doc = doc.select(F.concat(F.lit('{"primitives":['), F.array_join(F.transform("l", lambda s: s["j"]), ","), F.lit("]}")).alias("json"))
    out = D.normalize_primitives(doc)
    return out.select("id", "ord", "type", "name", "enabled", "mode", "elevation", "noiseScale", "priority", "height", "width", "edgeSmoothness", "splineSmoothness", F.size("anchors").alias("anchors"))


def preset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stored fields, some of which replace a preset."""
    names = F.array(*[F.lit(i) for i in PRESETS])
    first = F.get(names, (F.col("s_suppkey") - 1).cast("int"))
    stored = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey").between(1, 3), first).otherwise(F.format_string("field-%d", "s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    return D.merge_presets(stored, spark.createDataFrame([(i, p[0]) for i, p in PRESETS.items()], "id string, name string"))


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    new = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 10).cast("string").alias("id"), F.col("r_name").alias("name"))
    return store.upsert(old, new, "id")


def primitive_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = spark.createDataFrame([(i, p[0]) for i, p in PRESETS.items()], "id string, field string")
    names = F.array(*[F.lit(i) for i in PRESETS], F.lit("unknown"), F.lit(None).cast("string"))
    rows = primitives(spark, sf_dir).select("id", F.element_at(names, (F.pmod(F.col("ord"), F.lit(8)) + 1).cast("int")).alias("fieldId"))
    return D.with_field(rows, fields).select("id", "fieldId", "field")


MATH = {
    "nodes": [
        {"id": "p", "type": "cartesianPosition", "params": {}}, {"id": "half", "type": "constFloat", "params": {"value": 0.5}}, {"id": "sum", "type": "add", "params": {}},
        {"id": "minus", "type": "subtract", "params": {}}, {"id": "times", "type": "multiply", "params": {}}, {"id": "over", "type": "divide", "params": {}},
        {"id": "hold", "type": "clamp", "params": {"min": -2, "max": 3}}, {"id": "pow", "type": "power", "params": {"exponent": 2}}, {"id": "step", "type": "terrace", "params": {"steps": 4, "softness": 0.3}},
        {"id": "ramp", "type": "smoothstep", "params": {"edge0": 0.1, "edge1": 0.9}}, {"id": "out", "type": "output", "params": {}},
    ],
    "edges": [("p.x", "sum.a"), ("half.value", "sum.b"), ("sum.value", "minus.a"), ("p.y", "minus.b"), ("minus.value", "times.a"), ("half.value", "times.b"), ("times.value", "over.a"), ("p.y", "over.b"),
              ("over.value", "hold.in"), ("hold.value", "pow.in"), ("pow.value", "step.in"), ("step.value", "ramp.in"), ("ramp.value", "out.value")],
}


def math_graph(end: str = "ramp.value") -> dict:
    def ref(x: str) -> dict:
        return dict(zip(("nodeId", "portId"), x.split("."), strict=True))

    edges = [{"id": f"{a}>{b}", "from": ref(a), "to": ref(b)} for a, b in MATH["edges"] if b != "out.value"]
    return {"version": 1, "id": "math", "name": "Math", "nodes": MATH["nodes"], "edges": [*edges, {"id": "end", "from": ref(end), "to": ref("out.value")}]}


def graph_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 9 - 4).cast("double").alias("y"))
    return c.select("id", *[F.round(G.compile_graph(math_graph(e), F.col("x"), F.col("y")), 9).alias(a) for a, e in (("hold", "hold.value"), ("step", "step.value"), ("ramp", "ramp.value"))])


def preset_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All presets at every customer's place, one column each."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 3).alias("x"), (F.col("c_custkey") * 17.5).alias("z"))
    return c.select("id", *[F.round(G.compile_graph(p, F.col("x"), F.col("z")), 9).alias(p["id"].replace("-", "_")) for p in presets()])


def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs made of nations as nodes and suppliers as edges, most of them faulty."""
    types = F.array(*[F.lit(t) for t in ("output", "constFloat", "add", "cartesianPosition", "fbm2d")])
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("graph_id"), F.col("n_nationkey").cast("string").alias("node_id"), F.element_at(types, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("type"))
    s = table(spark, sf_dir, "supplier")
    ports = F.array(*[F.lit(p) for p in ("value", "x", "a", "xy")])
    e = s.select(
        (F.col("s_suppkey") % 5).cast("string").alias("graph_id"), F.col("s_suppkey").cast("int").alias("ord"), F.format_string("e%d", "s_suppkey").alias("edge_id"),
        (F.col("s_suppkey") * 7 % 25).cast("string").alias("from_node"), F.element_at(ports, (F.col("s_suppkey") % 2 + 1).cast("int")).alias("from_port"),
        (F.col("s_suppkey") * 3 % 25).cast("string").alias("to_node"), F.element_at(ports, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("to_port"),
    )
    return G.validate_table(n, e)


def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.fnv1a(F.concat("c_name", "c_mktsegment")).alias("hash"))


def r16_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.unpack_tiles(codecs.pack_tiles(heightmap(spark, sf_dir), TILE), TILE)


def png16(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = codecs.as_png(codecs.pack_tiles(heightmap(spark, sf_dir), TILE), TILE)
    return tiles.select("d", "y", "x", F.octet_length("data").alias("bytes"), F.hex(F.substring("data", 1, 8)).alias("signature"), F.crc32("data").alias("crc"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "undo").when(F.col("event_type") == "view", "commit").otherwise("redo")
    return e.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("ord"), action.alias("action"), F.col("event_id").cast("string").alias("value"))


def debounced_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.debounce(_edits(spark, sf_dir), pause="30 minutes")
    since = {c: F.expr(f"timestampdiff(MICROSECOND, cast('1970-01-01' as timestamp_ntz), cast({c} as timestamp_ntz))") for c in ("started", "saved")}
    return out.select("key", *[v.alias(c) for c, v in since.items()], "value", "n")


def newest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.newest_generation(_edits(spark, sf_dir).withColumn("generation", F.col("ord") * 7919 % 101))


def edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.history(_edits(spark, sf_dir))


def last_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.last_versions(_edits(spark, sf_dir), "key", ["ts", "ord"], 3).select("key", "value", "rank")


def bake_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edits(spark, sf_dir).withColumn("action", F.when(F.col("ord") % 5 == 0, "bake").when(F.col("ord") % 5 == 1, "done").when(F.col("ord") % 11 == 2, "error").otherwise(F.col("action")))
    return T.bake_status(e)


def io_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("ms"))
    return store.io_means(e).select("kind", F.round("mean_ms", 6).alias("mean_ms"))


_EDITS = """e AS (SELECT user_id::VARCHAR AS key, ts, event_id AS ord, CASE event_type WHEN 'click' THEN 'undo' WHEN 'view' THEN 'commit' ELSE 'redo' END AS action, event_id::VARCHAR AS value FROM events)"""
_PRESETS = ", ".join(f"('{i}', '{p[0]}')" for i, p in PRESETS.items())
_LIST = ", ".join(f"'{i}'" for i in PRESETS)
_PORTS = ", ".join(f"('{t}', '{name}', '{way}', '{kind}')" for t, n in G.NODES.items() for way, ports in (("input", n[2]), ("output", n[3])) for name, kind in ports)
_SS = "greatest(0::DOUBLE, least(1::DOUBLE, ({v} - {a}) / ({b} - {a})))"


def _ss(v: str, a: str, b: str) -> str:
    t = _SS.format(v=v, a=a, b=b)
    return f"({t} * {t} * (3 - 2 * {t}))"


QUERIES = {
    "validate_config": validate_config, "normalize_configs": normalize_configs, "normalize_primitives": normalize_primitives, "preset_union": preset_union, "registry_upsert": registry_upsert,
    "primitive_fields": primitive_fields, "graph_math": graph_math, "preset_fields": preset_fields, "graph_validate": graph_validate, "fnv_hashes": fnv_hashes, "r16_roundtrip": r16_roundtrip,
    "png16": png16, "debounced_saves": debounced_saves, "newest_generation": newest_generation, "edit_history": edit_history, "last_versions": last_versions, "bake_status": bake_status,
    "io_means": io_means,
}
SQL = {
    "validate_config": """WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE p_name END AS name, p_size AS ts, p_retailprice - 950 AS u, p_partkey % 33 AS s, p_partkey % 5 AS h FROM part)
SELECT id, array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'Name is required.' END, CASE WHEN ts < 2 THEN 'Tile size must be an integer greater than 1.' END,
  CASE WHEN ts NOT IN (1, 2, 4, 8, 16, 32, 64) THEN 'Tile size must be a power of two.' END, CASE WHEN u <= 0 THEN 'Unit size must be greater than zero.' END,
  CASE WHEN s NOT IN (1, 2, 4, 8, 16, 32) THEN 'World size must be a power-of-two tile count.' END, CASE WHEN h <= 0 THEN 'World height must be greater than zero.' END], lambda x: x IS NOT NULL), '|') AS errors FROM c""",
    "normalize_configs": "SELECT 'w' || c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN 1024 ELSE c_custkey END::DOUBLE AS worldHeight, c_custkey % 2 = 0 AS visible, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 50 ELSE 0 END::DOUBLE AS level FROM customer",
    "normalize_primitives": """WITH n AS (SELECT *, n_nationkey AS k, n_nationkey % 4 <> 0 AS area FROM nation WHERE n_nationkey % 4 <> 3)
SELECT 'p' || k AS id, (row_number() OVER (ORDER BY k) - 1)::INT AS ord, CASE WHEN area THEN 'landformArea' ELSE 'mountainSpline' END AS type, CASE WHEN k % 5 = 0 THEN 'Primitive' ELSE n_name END AS name, k % 6 <> 0 AS enabled,
  CASE WHEN area THEN CASE WHEN k % 2 = 0 THEN 'water' ELSE 'land' END END AS mode, CASE WHEN area THEN k * 10 END::DOUBLE AS elevation, CASE WHEN area THEN 80 END::DOUBLE AS noiseScale, CASE WHEN area THEN 0 END::DOUBLE AS priority,
  CASE WHEN NOT area THEN 0 END::DOUBLE AS height, CASE WHEN NOT area THEN 0 END::DOUBLE AS width, greatest(0, k - 12)::DOUBLE AS edgeSmoothness, least(1, k % 3)::DOUBLE AS splineSmoothness, 1 AS anchors FROM n""",
    "preset_union": f"""WITH s AS (SELECT CASE WHEN s_suppkey BETWEEN 1 AND 3 THEN [{_LIST}][s_suppkey] ELSE 'field-' || s_suppkey END AS id, s_name AS name FROM supplier)
SELECT * FROM s UNION ALL SELECT * FROM (VALUES {_PRESETS}) p(id, name) WHERE id NOT IN (SELECT id FROM s)""",
    "registry_upsert": """WITH n AS (SELECT (r_regionkey * 10)::VARCHAR AS id, r_name AS name FROM region)
SELECT * FROM n UNION ALL SELECT n_nationkey::VARCHAR, n_name FROM nation WHERE n_nationkey::VARCHAR NOT IN (SELECT id FROM n)""",
    "primitive_fields": f"""WITH {SHAPES}, f(id, field) AS (VALUES {_PRESETS}), p AS (SELECT pid, [{_LIST}, 'unknown', NULL][ord % 8 + 1] AS fid FROM prim)
SELECT pid AS id, fid AS "fieldId", field FROM p LEFT JOIN f ON f.id = fid""",
    "graph_math": f"""WITH c AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, (c_custkey % 9 - 4)::DOUBLE AS y FROM customer),
o AS (SELECT id, greatest(-2::DOUBLE, least(3::DOUBLE, CASE WHEN abs(y) <= 2.220446049250313e-16 THEN 0 ELSE (x + 0.5 - y) * 0.5::DOUBLE / y END)) AS hold FROM c),
w AS (SELECT *, greatest(0, hold) * greatest(0, hold) AS pw FROM o), v AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, pw)) AS v, least(3, floor(greatest(0::DOUBLE, least(1::DOUBLE, pw)) * 4)) AS cell FROM w),
s AS (SELECT *, cell / 4 + 0.25::DOUBLE * {_ss('greatest(0::DOUBLE, least(1::DOUBLE, v * 4 - cell))', '0.7::DOUBLE', '1')} AS step FROM v)
SELECT id, round(hold, 9) AS hold, round(step, 9) AS step, round({_ss('step', '0.1::DOUBLE', '0.9::DOUBLE')}, 9) AS ramp FROM s""",
    "graph_validate": f"""WITH n AS (SELECT n_regionkey::VARCHAR AS g, n_nationkey::VARCHAR AS node, ['output', 'constFloat', 'add', 'cartesianPosition', 'fbm2d'][n_nationkey % 5 + 1] AS type FROM nation),
ports(type, port, way, kind) AS (VALUES {_PORTS}), k AS (SELECT g, node, port, way, kind FROM n JOIN ports USING (type)),
e AS (SELECT (s_suppkey % 5)::VARCHAR AS g, s_suppkey AS ord, 'e' || s_suppkey AS edge_id, (s_suppkey * 7 % 25)::VARCHAR AS fn, ['value', 'x'][s_suppkey % 2 + 1] AS fp, (s_suppkey * 3 % 25)::VARCHAR AS tn, ['value', 'x', 'a', 'xy'][s_suppkey % 4 + 1] AS tp FROM supplier),
s AS (SELECT e.*, a.way AS fw, a.kind AS fk, b.way AS tw, b.kind AS tk FROM e LEFT JOIN k a ON a.g = e.g AND a.node = fn AND a.port = fp LEFT JOIN k b ON b.g = e.g AND b.node = tn AND b.port = tp),
r AS (SELECT *, fw IS NOT NULL AND tw IS NOT NULL AS good, row_number() OVER (PARTITION BY g, tn, tp, fw IS NOT NULL AND tw IS NOT NULL ORDER BY ord) AS rn FROM s)
SELECT g AS graph_id, NULL AS edge_id, '{G.ONE_OUTPUT}' AS message FROM n GROUP BY g HAVING count(*) FILTER (WHERE type = 'output') <> 1
UNION ALL SELECT g, edge_id, '{G.MISSING}' FROM r WHERE NOT good
UNION ALL SELECT g, edge_id, '{G.DIRECTION}' FROM r WHERE good AND (fw <> 'output' OR tw <> 'input')
UNION ALL SELECT g, edge_id, 'Cannot connect ' || fk || ' to ' || tk || '.' FROM r WHERE good AND fk <> tk
UNION ALL SELECT g, edge_id, '{G.ONE_EDGE}' FROM r WHERE good AND rn > 1""",
    "fnv_hashes": """WITH c AS (SELECT c_custkey, list_transform(string_split(c_name || c_mktsegment, ''), lambda x: unicode(x)::BIGINT) AS l FROM customer)
SELECT c_custkey, lower(printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, l),
  lambda a, u: (((xor(a, u) & 65535) * 16777619) + ((((xor(a, u) >> 16) * 16777619) & 65535) * 65536)) & 4294967295))) AS hash FROM c""",
    "r16_roundtrip": f"WITH {HEIGHTMAP} SELECT * FROM heightmap",
    "debounced_saves": f"""WITH {_EDITS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, ord)),
s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, ord) AS burst FROM g)
SELECT key, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS saved, arg_max(value, (ts, ord)) AS value, count(*) AS n FROM s GROUP BY key, burst""",
    "newest_generation": f"WITH {_EDITS}, g AS (SELECT *, ord * 7919 % 101 AS generation, row_number() OVER (PARTITION BY key ORDER BY ord * 7919 % 101 DESC, ts DESC, ord DESC) AS rn FROM e) SELECT key, generation, value FROM g WHERE rn = 1",
    "last_versions": f"WITH {_EDITS}, r AS (SELECT key, value, (row_number() OVER (PARTITION BY key ORDER BY ts DESC, ord DESC))::INT AS rank FROM e) SELECT * FROM r WHERE rank <= 3",
    "bake_status": f"""WITH {_EDITS}, a AS (SELECT key, ord, CASE WHEN ord % 5 = 0 THEN 'baking' WHEN ord % 5 = 1 THEN 'clean' WHEN ord % 11 = 2 THEN 'failed' ELSE 'stale' END AS status FROM e)
SELECT key, arg_max(status, ord) AS status FROM a GROUP BY key""",
    "io_means": "SELECT event_type AS kind, round(coalesce(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 0), 6) AS mean_ms FROM events GROUP BY 1",
}
