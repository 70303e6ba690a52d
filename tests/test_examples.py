"""Worked examples: keys, units, codecs, pyramid, primitives, graphs, documents, store, streams."""

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen import schema
from orogen.functions import keys as K
from orogen.functions import noise
from orogen.functions import scalars as S
from orogen.operators import bake as B
from orogen.operators import documents as D
from orogen.operators import editing as E
from orogen.operators import pyramid as P
from orogen.operators import sampling as V
from orogen.operators import shapes as G
from orogen.plans import graph as plan
from orogen.plans import presets
from orogen.queries import terrain
from orogen.sources import codecs
from orogen.sources.store import Store, boolean_setting
from orogen.streaming import edits as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def area(name, points, ord=0, **kw):
    base = dict(id=name, ord=ord, type=G.AREA, name=name, enabled=True, mode="land", elevation=200.0, noiseScale=0.0, priority=0.0, edgeSmoothness=0.0, splineSmoothness=0.0)
    return base | {"anchors": [{"id": f"{name}{i}", "x": float(x), "z": float(z)} for i, (x, z) in enumerate(points)]} | kw


def spline(name, points, ord=0, **kw):
    return area(name, points, ord, type=G.SPLINE, mode=None, elevation=None, noiseScale=None, priority=None, height=100.0, width=10.0) | kw


def frame(spark, *rows):
    return spark.createDataFrame([{"createdAt": None, "updatedAt": None, "height": None, "width": None, "fieldId": None} | r for r in rows], schema.PRIMITIVE)


SQUARE = [(-10, -10), (10, -10), (10, 10), (-10, 10)]


def weight_at(spark, row, x, z):
    got = G.prepare(frame(spark, row)).select(G.weight(F.lit(float(x)), F.lit(float(z))).alias("w")).first()
    return got["w"]


def test_keys(spark):
    assert one(spark, K.tile_path(F.lit(3), F.lit(2), F.lit(1))) == "tiles/d1/y2/x3.r16"
    assert one(spark, K.tile_path(F.lit(0), F.lit(1), F.lit(2), "png")) == "tiles/d2/y1/x0.png"
    assert spark.range(1).select(*K.parent(F.lit(3), F.lit(2), F.lit(0))).first() == (1, 1, 1)
    four = [tuple(r) for r in one(spark, K.children(F.lit(1), F.lit(1), F.lit(1)))]
    assert four == [(2, 2, 0), (3, 2, 0), (2, 3, 0), (3, 3, 0)]
    assert one(spark, K.children(F.lit(1), F.lit(1), F.lit(0))) == []
    up = K.ancestors(spark.createDataFrame([(7, 6, 0)], "x int, y int, d int"), 8)
    assert {tuple(r) for r in up.collect()} == {(3, 3, 1), (1, 1, 2), (0, 0, 3)}
    with pytest.raises(Exception, match="Invalid tile key"):
        K.checked_keys(spark.createDataFrame([(8, 0, 0)], "x int, y int, d int"), 8).collect()


def test_units(spark):
    assert one(spark, K.linear_size(F.lit(1024), F.lit(8), F.lit(0.5))) == 4096
    assert one(spark, K.area_square_miles(F.lit(5280), F.lit(2), F.lit(1), F.lit("foot"))) == 4
    assert [round(one(spark, K.meters_to_units(F.lit(2.0), F.lit(u))), 5) for u in ("foot", "meter", "cm")] == [6.56168, 2, 200]
    assert one(spark, K.lod_tile_count(F.lit(16))) == 85
    with pytest.raises(ValueError):
        K.max_depth(3)


def test_scalars(spark):
    assert one(spark, S.fnv1a(F.lit("abc"))) == "1a47e90b"
    assert one(spark, S.fnv1a(F.lit(""))) == "811c9dc5"
    assert [one(spark, S.half_up(F.lit(x))) for x in (-1.5, -0.5, 0.5, 2.5)] == [-1, 0, 1, 3]
    assert math.isnan(one(spark, S.clamp(F.lit(float("nan")), 0, 1)))
    assert one(spark, S.safe_divide(F.lit(3.0), F.lit(1e-17))) == 0
    assert [one(spark, S.smoothstep(2, 2, F.lit(x))) for x in (1.9, 2.0)] == [0, 1]
    assert one(spark, S.terrace(F.lit(0.3), 4, 1.0)) == pytest.approx(0.3)
    assert one(spark, F.crc32(F.lit("abc"))) == zlib.crc32(b"abc")
    assert [one(spark, S.finite_or(F.lit(x), 7)) for x in ("120", "x", "NaN")] == [120, 7, 7]


def test_noise():
    assert sorted(noise.permutation(5)[:256]) == list(range(256))
    x, y = np.random.default_rng(0).uniform(-500, 500, (2, 20000))
    v = noise.simplex2(7, x, y)
    assert np.abs(v).max() <= 1 and np.array_equal(v, noise.simplex2(7, x, y))
    assert not np.array_equal(v, noise.simplex2(8, x, y)) and np.isnan(noise.simplex2(1, np.array([np.inf]), np.array([0.0])))[0]
    assert noise.prng(0, 3) == noise.prng(1, 3) and all(0 <= r < 1 for r in noise.prng(9, 100))


def test_codecs(spark):
    data = codecs.encode_samples([0, 1, 256, 65535])
    assert data[2:4] == b"\x01\x00" and codecs.decode_samples(data, 2).tolist() == [0, 1, 256, 65535]
    with pytest.raises(ValueError, match="Invalid R16"):
        codecs.decode_samples(b"123456", 2)
    png = codecs.png_gray16(2, 1, [1, 65535])
    body = png[png.index(b"IDAT") + 4 :]
    assert png.startswith(codecs.SIGNATURE) and zlib.decompressobj().decompress(body) == b"\x00\x00\x01\xff\xff"
    with pytest.raises(ValueError):
        codecs.png_gray16(2, 2, [1])


def level(spark, grid):
    return spark.createDataFrame([(0, y, x, int(v)) for y, line in enumerate(grid) for x, v in enumerate(line)], "d int, gy int, gx int, h int")


def test_pyramid(spark):
    four = np.block([[np.array([[0, 2], [4, 6]]), np.array([[10, 12], [14, 16]])], [np.array([[20, 22], [24, 26]]), np.array([[30, 32], [34, 36]])]])
    up = P.next_level(level(spark, four))
    assert {(r["gy"], r["gx"]): r["h"] for r in up.collect()} == {(0, 0): 3, (0, 1): 13, (1, 0): 23, (1, 1): 33}
    with pytest.raises(Exception, match="exactly four"):
        P.next_level(level(spark, four).where("gx > 0")).collect()
    tiles = np.kron(np.array([[0, 1], [10, 11]]), np.ones((2, 2), int))
    dirty = spark.createDataFrame([(1, 1, 0)], "x int, y int, d int")
    new = P.rebuild_dirty(P.pyramid(level(spark, tiles), 1), dirty, 2, 2).collect()
    assert {(r["d"], r["gy"], r["gx"], r["h"]) for r in new} == {(1, 0, 0, 0), (1, 0, 1, 1), (1, 1, 0, 10), (1, 1, 1, 11)}
    ranges = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1200), ("b", 2600)], "k string, h int")
    assert {r["k"]: r["usable"] for r in P.usable_range(ranges, ["k"]).collect()} == {"a": False, "b": True}


def test_weights(spark):
    soft = area("a", SQUARE, edgeSmoothness=5.0)
    assert [round(weight_at(spark, soft, x, 0), 3) for x in (0, 9.5, 20)] == [1, 0.028, 0]
    ridge = spline("m", [(-100, 0), (100, 0)], edgeSmoothness=5.0)
    assert [round(weight_at(spark, ridge, 0, z), 3) for z in (0, 4, 5, 6)] == [1, 0.104, 0, 0]
    bent = [(0, 0), (10, 10), (20, 10), (30, 0)]
    assert weight_at(spark, spline("s", bent, splineSmoothness=1.0, width=2.0, edgeSmoothness=0.5), 15, 11.25) > 0.9
    assert weight_at(spark, spline("s", bent, splineSmoothness=0.0, width=2.0, edgeSmoothness=0.5), 15, 11.25) == 0


def test_points(spark):
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 9.5, 0.0), (2, 500.0, 0.0)], "id long, x double, z double")
    layers = frame(spark, area("low", SQUARE, 0, priority=1.0), area("high", SQUARE, 1, elevation=600.0, priority=2.0), area("later", SQUARE, 2, elevation=400.0, priority=2.0))
    got = {r["id"]: r for r in B.evaluate_points(at, layers, B.World(height=1000.0)).collect()}
    assert (got[0]["landform"], got[0]["elevation"]) == ("later", 400) and (got[2]["landform"], got[2]["elevation"]) == (None, 0)
    edge = frame(spark, area("base", SQUARE, 0), area("top", SQUARE, 1, elevation=600.0, priority=1.0, edgeSmoothness=5.0))
    got = {r["id"]: r for r in B.evaluate_points(at, edge, B.World(height=1000.0)).collect()}
    assert got[1]["elevation"] == pytest.approx(211.2)


def test_bake(spark):
    world = B.World(tile_size=2, tiles_per_side=2, unit=1.0, height=100.0)
    big = [(-100, -100), (100, -100), (100, 100), (-100, 100)]
    baked = B.bake(frame(spark, area("p", big, elevation=80.0, splineSmoothness=None)), world)
    assert {r["h"] for r in baked.collect()} == {52428} and baked.count() == 16
    lift = {"id": "f", "nodes": [{"id": "c", "type": "constFloat", "params": {"value": 1}}, {"id": "o", "type": "output", "params": {}}]}
    lift["edges"] = [{"id": "e", "from": {"nodeId": "c", "portId": "value"}, "to": {"nodeId": "o", "portId": "value"}}]
    baked = B.bake(frame(spark, area("p", big, elevation=50.0, noiseScale=20.0, fieldId="f")), world, [lift])
    assert {r["h"] for r in baked.collect()} == {45875}
    up = spline("m", [(-100, 0), (100, 0)], 1, width=500.0, height=90.0)
    baked = B.bake(frame(spark, area("p", big, elevation=80.0), up), world)
    assert {r["h"] for r in baked.collect()} == {65535}
    assert B.bake(frame(spark, area("p", big, enabled=False)), world).count() == 0
    assert B.bake(frame(spark, area("p", big)).limit(0), world).count() == 0
    assert B.dense(B.bake(frame(spark, area("p", SQUARE).copy() | {"enabled": False}), world), world).agg(F.sum("h"), F.count("h")).first() == (0, 16)


def test_graphs(spark):
    for g in presets.presets():
        assert plan.validate(g) == []
        assert -1.5 <= plan.evaluate(spark, g, 100, 200) <= 1.5
    g = plan.create_graph("g", "G")
    position, output = (n["id"] for n in g["nodes"])
    assert plan.evaluate(spark, g, 3, 4) == 1
    g = plan.connect(g, {"nodeId": output, "portId": "value"}, {"nodeId": position, "portId": "y"})
    assert plan.evaluate(spark, g, 3, 4) == 4
    g = plan.connect(g, {"nodeId": position, "portId": "x"}, {"nodeId": output, "portId": "value"})
    assert len(g["edges"]) == 1 and plan.evaluate(spark, g, 3, 4) == 3
    assert plan.connect(g, {"nodeId": position, "portId": "xy"}, {"nodeId": output, "portId": "value"}) is None
    assert plan.delete(g, node_id=output) == g and plan.delete(g, node_id=position)["edges"] == []
    loop = {"id": "l", "nodes": [{"id": "a", "type": "add", "params": {}}, {"id": "o", "type": "output", "params": {}}], "edges": []}
    loop = plan.connect(plan.connect(loop, {"nodeId": "a", "portId": "value"}, {"nodeId": "o", "portId": "value"}), {"nodeId": "a", "portId": "value"}, {"nodeId": "o", "portId": "value"})
    loop["edges"].append({"id": "x", "from": {"nodeId": "a", "portId": "value"}, "to": {"nodeId": "a", "portId": "a"}})
    assert plan.validate(loop) == [] and plan.compile_graph(loop, F.lit(0.0), F.lit(0.0)) is None and plan.evaluate(spark, loop, 0, 0) == 0
    odd = plan.normalize({"nodes": [{"id": "c", "type": "constFloat", "params": {"value": "2"}}, {"type": "nothing"}, {"id": "o", "type": "output"}], "edges": [{"id": "e", "from": {"nodeId": "o", "portId": "value"}, "to": {"nodeId": "c", "portId": "value"}}, {"from": 1}]}, "n")
    assert plan.evaluate(spark, odd, 0, 0) == 2 and odd["name"] == "Field" and len(odd["nodes"]) == 2
    assert plan.search_nodes("NOISE") == ["simplex2d", "fbm2d", "ridged2d"] and "output" not in plan.search_nodes("")
    many = plan.graph_tables(spark, [*presets.presets(), {"id": "bad", "nodes": [{"id": "c", "type": "constFloat", "params": {}}], "edges": []}])
    assert [tuple(r) for r in plan.validate_table(*many).collect()] == [("bad", None, plan.ONE_OUTPUT)]


def test_documents(spark):
    rows = spark.createDataFrame([("w", 1000.0, 1.0, "foot", 3.0, 10.0)], "name string, tileSize double, unitSize double, unit string, tilesPerSide double, worldHeight double")
    assert rows.select(D.config_errors().alias("e")).first()["e"] == ["Tile size must be a power of two.", "World size must be a power-of-two tile count."]
    with pytest.raises(Exception, match="power of two"):
        D.create_worlds(rows).collect()
    good = D.create_worlds(rows.withColumn("tileSize", F.lit(1024.0)).withColumn("tilesPerSide", F.lit(4.0)))
    assert good.first()["water"] == (False, 0.0) and D.with_water(good, True, 99.0).first()["water"] == (True, 10.0)
    assert D.with_height(D.with_water(good, True, 9.0), 3.6).first()["water"]["level"] == 4
    legacy = spark.createDataFrame([('{"id":"a","maxElevation":900}',)], "json string")
    assert tuple(D.normalize_configs(legacy).first()) == ("a", 900.0, False, 0.0)
    raw = {"primitives": [{"id": "p", "type": "landformArea", "elevation": "120", "edgeSmoothness": -4, "splineSmoothness": "2", "priority": "3", "anchors": [{"id": "a", "x": 1, "z": "2"}, {"x": "no", "z": 1}]}, {"type": "castle"}]}
    got = D.normalize_primitives(spark.createDataFrame([(json.dumps(raw),)], "json string")).collect()
    assert len(got) == 1 and (got[0]["elevation"], got[0]["edgeSmoothness"], got[0]["splineSmoothness"], got[0]["priority"], got[0]["noiseScale"], len(got[0]["anchors"])) == (120, 0, 1, 3, 80, 1)
    assert [f["id"] for f in D.normalize_document("junk", "w")["fieldLibrary"]] == list(presets.PRESETS)
    new = D.new_primitive(spark, G.AREA, [("a", 0, 0)], 20.0, 3).first()
    assert (new["name"], new["elevation"], new["edgeSmoothness"]) == ("Landform 3", 100.0, 120.0)
    world = spark.createDataFrame([("w", 2.0, 4.0, 0.5, 100.0)], "id string, tileSize double, tilesPerSide double, unitSize double, worldHeight double")
    text, want = '{"config":{"id":"w","tileSize":2,"tilesPerSide":4,"unitSize":0.5,"worldHeight":100},"waterLevel":1,"primitives":[]}', 2166136261
    for c in text.encode():
        want = (want ^ c) * 16777619 % 2**32
    assert D.input_hash(world, "[]", 1.0).first()["hash"] == f"{want:08x}"
    assert D.bake_record(spark, "t", "failed", "", 0, 0, "no").first()["status"] == "failed"


def test_editing(spark):
    rows = frame(spark, area("a", SQUARE), spline("m", [(0, 0), (50, 0)], 1))
    at = spark.createDataFrame([(1, 10.0, 10.0), (2, 30.0, 1.0), (3, 900.0, 0.0)], "id long, x double, z double")
    hits = E.primitive_hits(at, rows, 4.0)
    assert {(r["id"], r["primitive"], r["rank"]) for r in hits.collect()} == {(1, "a", 1), (2, "m", 1)}
    assert {(r["id"], r["anchor"]) for r in E.nearest_anchor(at, rows, 24.0).collect()} >= {(1, "a2"), (2, "m1")}
    assert {(r["id"], r["primitive"], r["insert_at"]) for r in E.nearest_segment(at, rows, 24.0).collect()} >= {(2, "m", 1)}
    assert E.delete_anchor(rows, "m", "m0").where("id = 'm'").first()["anchors"].__len__() == 2
    assert E.hit_threshold(None) == 30 and E.hit_threshold(B.World(tile_size=1024, tiles_per_side=16)) == pytest.approx(98.304)
    turned = rows.select(E.rotated(F.col("anchors"), (0.0, 0.0), 0.0, (0.0, 5.0)).alias("t")).first()["t"]
    assert (round(turned[0]["x"], 9), round(turned[0]["z"], 9)) == (10, -10)
    kept, fields = E.delete_field(rows.withColumn("fieldId", F.lit("f")), spark.createDataFrame([("f",), ("g",)], "id string"), "f")
    assert kept.where("fieldId is not null").count() == 0 and fields.count() == 1


def test_views(spark):
    world = B.World(tile_size=64, tiles_per_side=4)
    wide = V.Camera(0, 0, 10.0, visible=(1000.0, 1000.0))
    assert [tuple(r) for r in V.select_chunks(spark, wide, world).collect()] == [(2, 0, 0)]
    close = V.Camera(0, 0, 100000.0, visible=(1000.0, 1000.0))
    assert V.select_chunks(spark, close, world).count() == 16
    assert V.selection_totals(V.select_chunks(spark, close, world)).first()["vertices"] == 16 * 65**2
    need = V.chunk_tiles(V.select_chunks(spark, wide, world), world)
    assert V.missing_tiles(need, need.limit(0)).count() == 1 and V.missing_tiles(need, need).count() == 0
    assert one(spark, V.units_per_pixel(wide, F.lit(3.0))) == 100


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    tiles = codecs.pack_tiles(P.pyramid(level(spark, np.arange(16).reshape(4, 4)), 1), 2)
    store.write_tiles("w", tiles)
    assert store.read_tiles("w").count() == 5 and store.read_tile("w", 1, 1, 0, 2).count() == 1
    with pytest.raises(ValueError):
        store.read_tile("w", 2, 0, 0, 2)
    store.write_raw("w2", store.read_tiles("w"))
    back = store.read_raw("w2")
    assert {(r["d"], r["y"], r["x"], bytes(r["data"])) for r in back.collect()} == {(r["d"], r["y"], r["x"], bytes(r["data"])) for r in tiles.collect()}
    store.write_config("w", {"id": "w", "maxElevation": 9})
    assert store.read_config("w")["worldHeight"] == 9
    store.export_png("w", "out", 2)
    assert len(list((tmp_path / "out" / "tiles").rglob("*.png"))) == 5
    store.write_document("w", {"primitives": [], "worldId": "other"})
    assert store.read_document("w")["worldId"] == "w" and len(store.read_document("none")["fieldLibrary"]) == 6
    assert store.projects().count() == 0 and store.open_last() is None
    store.register("w", "World", "2024-01-02")
    store.register("v", "Other", "2024-01-03")
    store.register("w", "World 2", "2024-01-04")
    assert [r["name"] for r in store.projects().collect()] == ["World 2", "Other"] and store.open_last()["id"] == "w"
    store.delete("w")
    store.delete("missing")
    assert [r["id"] for r in store.projects().collect()] == ["v"] and store.open_last() is None
    assert boolean_setting(spark, "no.such.setting", True) is True


def test_streams(spark, tmp_path):
    rows = [("a", 1, "commit", "1"), ("a", 2, "commit", "2"), ("a", 3, "undo", None), ("a", 4, "redo", None), ("a", 5, "undo", None), ("a", 6, "commit", "9"), ("b", 1, "undo", None)]
    edits = spark.createDataFrame(rows, "key string, ord long, action string, value string")
    want = {("a", "9", 1, 0), ("b", None, 0, 0)}
    assert {tuple(r) for r in T.history(edits).collect()} == want
    edits.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.history_stream(spark.readStream.schema(edits.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == want
    saves = spark.createDataFrame([("k", "2024-01-01 00:00:00.0", 1, "x"), ("k", "2024-01-01 00:00:00.2", 2, "y"), ("k", "2024-01-01 00:00:01", 3, "z")], "key string, t string, ord long, value string")
    saves = saves.withColumn("ts", F.to_timestamp("t"))
    assert {(r["value"], r["n"]) for r in T.debounce(saves).collect()} == {("y", 2), ("z", 1)}
    found = T.newest_generation(saves.withColumn("generation", F.when(F.col("value") == "y", 5).otherwise(1)))
    assert [(r["generation"], r["value"]) for r in found.collect()] == [(5, "y")]


def test_dirty_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    grid = np.zeros((4, 4), int)
    stale = P.pyramid(level(spark, grid), 1).where("d = 1").unionByName(level(spark, grid + 8))
    store.write_tiles("w", codecs.pack_tiles(stale, 2))
    spark.createDataFrame([(0, 0, 0)], "x int, y int, d int").write.parquet(f"{tmp_path}/dirty")
    stream = spark.readStream.schema("x int, y int, d int").parquet(f"{tmp_path}/dirty")
    T.keep_pyramid(stream, store, "w", 2, 2, f"{tmp_path}/c").awaitTermination()
    top = codecs.unpack_tiles(store.read_tiles("w").where("d = 1"), 2)
    assert {r["h"] for r in top.collect()} == {8}


def test_lifecycle(spark, tmp_path):
    from orogen.plans import lifecycle

    store = Store(spark, f"file://{tmp_path}")
    config = {"name": " World ", "tileSize": 2, "tilesPerSide": 2, "unitSize": 1, "unit": "foot", "worldHeight": 100}
    with pytest.raises(ValueError, match="power of two. Unit size"):
        lifecycle.create_world(store, "w", config | {"tileSize": 3, "unitSize": 0})
    assert lifecycle.create_world(store, "w", config)["name"] == "World"
    assert codecs.unpack_tiles(store.read_tiles("w"), 2).agg(F.sum("h"), F.count("h")).first() == (0, 20)
    assert lifecycle.open_project(store, "w")["id"] == "w" and store.open_last()["id"] == "w"
    anchors = [{"id": f"a{i}", "x": x, "z": z} for i, (x, z) in enumerate([(-9, -9), (9, -9), (9, 9), (-9, 9)])]
    document = {"primitives": [{"id": "p", "type": "landformArea", "elevation": 80, "anchors": anchors}]}
    saved = lifecycle.bake_project(store, "w", document)
    assert saved["lastBake"]["status"] == "clean" and saved["lastBake"]["tileCount"] == 5 and store.read_document("w")["lastBake"]["primitiveCount"] == 1
    assert {r["h"] for r in codecs.unpack_tiles(store.read_tiles("w"), 2).collect()} == {52428}

    class Full(Store):
        def write_tiles(self, project, tiles):
            raise OSError("no space left")

    with pytest.raises(OSError):
        lifecycle.bake_project(Full(spark, f"file://{tmp_path}"), "w", document)
    failed = store.read_document("w")["lastBake"]
    assert (failed["status"], failed["error"]) == ("failed", "no space left")


def test_whole_chunk_mesh(spark):
    """All 21 chunks of the heightmap, against arrays: also the lower and right borders, where heights are held."""
    sf = "/root/testdata/sf0.001"
    level = np.zeros((64, 64), "i8")
    for r in terrain.heightmap(spark, sf).collect():
        level[r["gy"], r["gx"]] = r["h"]
    got = {(r["lod"], r["cy"], r["cx"], r["vy"], r["vx"]): r for r in terrain.chunk_mesh_whole(spark, sf).collect()}
    assert len(got) == 21 * 17 * 17
    for lod in range(3):
        side = 64 >> lod
        at = lambda y, x: level[np.clip(y, 0, side - 1), np.clip(x, 0, side - 1)] / 65535 * 1000  # noqa: B023, E731
        y, x = np.mgrid[: side + 1, : side + 1]
        sx, sz = at(y, x - 1) - at(y, x + 1), at(y - 1, x) - at(y + 1, x)
        long = np.sqrt(sx * sx + 4 + sz * sz)
        want = {"height": at(y, x), "nx": sx / long, "ny": 2 / long, "nz": sz / long}
        for cy, cx, vy, vx in np.ndindex(side // 16, side // 16, 17, 17):
            r = got[lod, cy, cx, vy, vx]
            assert all(r[k] == pytest.approx(v[cy * 16 + vy, cx * 16 + vx], abs=2e-6) for k, v in want.items())
        level = (level.reshape(side // 2, 2, side // 2, 2).sum(axis=(1, 3)) + 2) // 4
