"""Whole lifecycles of a project: create a world, open it, bake and store it."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import keys as K
from ..operators import bake as B
from ..operators import documents as D
from ..operators import pyramid as P
from ..sources import codecs
from ..sources.store import Store


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def world_of(config: dict) -> B.World:
    water = config.get("water") or {}
    return B.World(int(config["tileSize"]), int(config["tilesPerSide"]), float(config["unitSize"]), float(config["worldHeight"]), float(water.get("level") or 0))


def every_tile(spark: SparkSession, world: B.World) -> DataFrame:
    """d, y, x of the whole pyramid."""
    out = None
    for d in range(K.max_depth(world.tiles_per_side) + 1):
        n = world.tiles_per_side >> d
        level = spark.range(n * n).select(F.lit(d).alias("d"), F.expr(f"cast(id div {n} as int)").alias("y"), F.expr(f"cast(id % {n} as int)").alias("x"))
        out = level if out is None else out.unionByName(level)
    return out


def whole_pyramid(packed: DataFrame, world: B.World) -> DataFrame:
    """packed tiles (d, y, x, data) and zeros for all others."""
    zeros = F.unhex(F.repeat(F.lit("00"), 2 * world.tile_size**2))
    return every_tile(packed.sparkSession, world).join(packed, ["d", "y", "x"], "left").withColumn("data", F.coalesce("data", zeros))


def create_world(store: Store, project: str, config: dict) -> dict:
    """A new world of height 0: its config, document, registry row and all tiles. An invalid config fails with all its messages."""
    spark = store.spark
    columns = {"name": "string", "tileSize": "double", "unitSize": "double", "unit": "string", "tilesPerSide": "double", "worldHeight": "double"}
    row = spark.createDataFrame([tuple(None if config.get(c) is None else (float(config[c]) if t == "double" else config[c]) for c, t in columns.items())], ", ".join(f"{c} {t}" for c, t in columns.items()))
    errors = row.select(D.config_errors().alias("e")).first()["e"]
    if errors:
        raise ValueError(" ".join(errors))
    now = _now()
    made = config | {"id": project, "name": config["name"].strip(), "water": {"visible": False, "level": 0}, "createdAt": now, "updatedAt": now, "version": 1}
    store.write_config(project, made)
    store.write_document(project, D.normalize_document(None, project))
    store.register(project, made["name"], now)
    none = spark.createDataFrame([], "d int, y int, x int, data binary")
    store.write_tiles(project, whole_pyramid(none, world_of(made)))
    return made


def open_project(store: Store, project: str) -> dict:
    """The project's config; it becomes the one that open_last opens."""
    config = store.read_config(project)
    store.register(project, config.get("name", project), config.get("updatedAt", ""))
    return config


def primitives_of(spark: SparkSession, document: dict) -> DataFrame:
    raw = spark.createDataFrame([(json.dumps({"primitives": document["primitives"]}),)], "json string")
    return D.normalize_primitives(raw)


def baked_tiles(primitives: DataFrame, world: B.World, library: list[dict]) -> DataFrame:
    """Tiles of all levels of a bake; only samples above 0 are worked out, level from stored level."""
    s = world.tile_size
    level = B.bake(primitives, world, library).where("h > 0")
    level = level.select(F.lit(0).alias("d"), (F.col("ty") * s + F.col("sy")).alias("gy"), (F.col("tx") * s + F.col("sx")).alias("gx"), "h")
    out = level
    for _ in range(K.max_depth(world.tiles_per_side)):
        level = P.sparse_next(level)
        out = out.unionByName(level)
    return whole_pyramid(codecs.pack_tiles(out, s), world)


def bake_project(store: Store, project: str, document: dict) -> dict:
    """Bake a document, store its tiles, and save it with a record of the bake; returns the saved document.

    If the bake fails the document is saved with a record of the failure, and the stored tiles stay.
    """
    spark, config, started = store.spark, store.read_config(project), _now()
    world, document = world_of(config), D.normalize_document(document, project)
    rows = spark.createDataFrame([(project, float(config["tileSize"]), float(config["tilesPerSide"]), float(config["unitSize"]), float(config["worldHeight"]))], "id string, tileSize double, tilesPerSide double, unitSize double, worldHeight double")
    digest = D.input_hash(rows, json.dumps(document["primitives"], separators=(",", ":"), ensure_ascii=False), world.water).first()["hash"]
    tiles, status, error = sum((world.tiles_per_side >> d) ** 2 for d in range(K.max_depth(world.tiles_per_side) + 1)), "clean", None
    primitives = primitives_of(spark, document).cache()  # ids that are made up must be the same throughout
    try:
        store.write_tiles(project, baked_tiles(primitives, world, document["fieldLibrary"]))
    except Exception as e:  # noqa: BLE001  any failure is recorded, then raised
        status, error = "failed", str(e)[:500]
        raise
    finally:
        record = D.bake_record(spark, started, status, digest, primitives.where("enabled").count(), tiles, error).select(*[f.split()[0] for f in schema.BAKE.split(", ")])
        document["lastBake"] = {k: v for k, v in record.first().asDict().items() if v is not None}
        store.write_document(project, document)
        primitives.unpersist()
    return document
