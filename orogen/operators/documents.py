"""World configs and authoring documents: validation, lenient normalization, defaults, bake records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.scalars import clamp, finite_or, fnv1a, half_up
from ..plans.graph import normalize
from ..plans.presets import presets
from . import shapes

# Defaults of a new world and of primitives.
WORLD_HEIGHT, NOISE_SCALE, NAME = 1024.0, 80.0, "Primitive"
MODES, UNITS = ("land", "water", "plateau"), ("foot", "meter", "cm")


def config_errors() -> Column:
    """The messages about a config row (name, tileSize, unitSize, tilesPerSide, worldHeight), in their fixed order."""
    size, unit, side, height = (F.col(c) for c in ("tileSize", "unitSize", "tilesPerSide", "worldHeight"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    checks = [
        (F.length(F.trim(F.coalesce("name", F.lit("")))) > 0, "Name is required."),
        (finite(size) & (size == F.floor(size)) & (size >= 2), "Tile size must be an integer greater than 1."),
        (K.is_power_of_two(size), "Tile size must be a power of two."),
        (finite(unit) & (unit > 0), "Unit size must be greater than zero."),
        (K.is_power_of_two(side), "World size must be a power-of-two tile count."),
        (finite(height) & (height > 0), "World height must be greater than zero."),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in checks]))


def create_worlds(inputs: DataFrame) -> DataFrame:
    """Valid inputs as new worlds: id, trimmed name, dry water, version 1. An invalid input fails with all its messages."""
    bad = config_errors()
    checked = F.assert_true(F.size(bad) == 0, F.array_join(bad, " "))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return inputs.where(checked.isNull()).select(
        F.uuid().alias("id"), F.trim("name").alias("name"), "tileSize", "unitSize", "unit", "tilesPerSide", "worldHeight",
        F.struct(F.lit(False).alias("visible"), F.lit(0.0).alias("level")).alias("water"), now.alias("createdAt"), now.alias("updatedAt"), F.lit(1).alias("version"),
    )


def normalize_configs(raw: DataFrame) -> DataFrame:
    """json (string) to id, worldHeight, visible, level: older names and missing water are filled in, nothing is re-validated."""
    get = lambda path: F.get_json_object("json", f"$.{path}")
    height = F.coalesce(get("worldHeight").try_cast("double"), get("maxElevation").try_cast("double"), F.lit(WORLD_HEIGHT))
    level = get("water.level").try_cast("double")
    return raw.select(get("id").alias("id"), height.alias("worldHeight"), F.coalesce(get("water.visible") == "true", F.lit(False)).alias("visible"), F.coalesce(level, F.lit(0.0)).alias("level"))


def with_water(configs: DataFrame, visible: bool, level: float) -> DataFrame:
    """configs with a new water level, held between 0 and the world's height."""
    return configs.withColumn("water", F.struct(F.lit(visible).alias("visible"), clamp(finite_or(F.lit(level), 0), 0, F.col("worldHeight")).alias("level")))


def with_height(configs: DataFrame, height: float) -> DataFrame:
    """configs with a new height, rounded and at least 1, and their water held below it."""
    new = F.greatest(F.lit(1).cast("bigint"), half_up(F.lit(float(height)))).cast("double")
    return configs.withColumn("worldHeight", new).withColumn("water", F.struct(F.col("water.visible").alias("visible"), clamp(F.col("water.level"), 0, new).alias("level")))


_RAW = (
    "id string, type string, name string, enabled string, createdAt string, updatedAt string, mode string, elevation string, noiseScale string, priority string, height string, "
    "width string, fieldId string, edgeSmoothness string, splineSmoothness string, anchors array<struct<id:string,x:string,z:string>>"
)


def normalize_primitives(raw: DataFrame) -> DataFrame:
    """json (an authoring document) to its primitives, one row each with ord, its place in its own document.

    Unknown types and anchors that are no points go, numbers are read leniently. Other columns of raw, such
    as a document's id, come first in each row.
    """
    others = [c for c in raw.columns if c != "json"]
    listed = F.from_json(F.get_json_object("json", "$.primitives"), f"array<struct<{_RAW.replace(' string', ':string').replace(' array', ':array')}>>", {"mode": "PERMISSIVE"})
    known = F.filter(listed, lambda p: p["type"].isin(shapes.AREA, shapes.SPLINE))
    rows = raw.select(*[F.col(f"`{c}`") for c in others], F.posexplode(known).alias("ord", "p"))
    p = F.col("p")
    text = lambda c: F.when(F.length(c) > 0, c)
    point = lambda v: finite_or(v, float("nan"))
    anchors = F.transform(F.coalesce(p["anchors"], F.array().cast("array<struct<id:string,x:string,z:string>>")), lambda a: F.struct(a["id"].alias("id"), point(a["x"]).alias("x"), point(a["z"]).alias("z")))
    anchors = F.filter(anchors, lambda a: ~F.isnan(a["x"]) & ~F.isnan(a["z"]))
    area = p["type"] == shapes.AREA
    zero = F.lit(0.0)
    return rows.select(
        *[F.col(f"`{c}`") for c in others], F.coalesce(text(p["id"]), F.uuid()).alias("id"), "ord", p["type"].alias("type"),
        F.when(F.length(F.trim(p["name"])) > 0, p["name"]).otherwise(NAME).alias("name"), (F.coalesce(p["enabled"], F.lit("true")) != "false").alias("enabled"),
        p["createdAt"].alias("createdAt"), p["updatedAt"].alias("updatedAt"),
        F.when(area, F.when(p["mode"].isin(*MODES), p["mode"]).otherwise("land")).alias("mode"), F.when(area, finite_or(p["elevation"], 0)).alias("elevation"),
        F.when(area, finite_or(p["noiseScale"], NOISE_SCALE)).alias("noiseScale"), F.when(area, finite_or(p["priority"], 0)).alias("priority"),
        F.when(~area, finite_or(p["height"], 0)).alias("height"), F.when(~area, F.greatest(zero, finite_or(p["width"], 0))).alias("width"), text(p["fieldId"]).alias("fieldId"),
        F.greatest(zero, finite_or(p["edgeSmoothness"], 0)).alias("edgeSmoothness"), clamp(finite_or(p["splineSmoothness"], shapes.SMOOTHNESS), 0, 1).alias("splineSmoothness"),
        anchors.alias("anchors"),
    )


def normalize_document(value, world_id: str) -> dict:
    """A whole document from any JSON value, for the driver: its graphs, the missing presets behind them, and a valid bake record or none."""
    value = value if isinstance(value, dict) else {}
    stored = value["fieldLibrary"] if isinstance(value.get("fieldLibrary"), list) else []
    fields = [normalize(f, f"field-{i + 1}", f"Field {i + 1}") for i, f in enumerate(stored)]
    known = {f["id"] for f in fields}
    out = {"version": 1, "worldId": world_id, "fieldLibrary": fields + [p for p in presets() if p["id"] not in known]}
    out["primitives"] = value["primitives"] if isinstance(value.get("primitives"), list) else []
    if isinstance(value.get("lastBake"), dict) and value["lastBake"].get("status") in ("clean", "failed"):
        out["lastBake"] = value["lastBake"]
    return out


def merge_presets(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Stored rows, then the defaults whose id none of them has."""
    return stored.unionByName(defaults.join(stored.select("id"), "id", "left_anti"))


def with_field(primitives: DataFrame, fields: DataFrame) -> DataFrame:
    """primitives beside the field that fieldId names; null for none and for an unknown one."""
    return primitives.join(fields.withColumnRenamed("id", "fieldId"), "fieldId", "left")


def new_primitive(spark: SparkSession, kind: str, anchors: list[tuple[str, float, float]], water: float, index: int) -> DataFrame:
    """One new primitive with its defaults."""
    # The defaults of new primitives.
    area = kind == shapes.AREA
    given = [(a, float(x), float(z)) for a, x, z in anchors]
    row = spark.createDataFrame([(kind, given)], f"type string, anchors array<{'struct<id:string,x:double,z:double>'}>")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    pick = lambda v, on: F.lit(v if on else None)
    return row.select(
        F.uuid().alias("id"), F.lit(index).alias("ord"), "type", F.lit(f"{'Landform' if area else 'Mountain'} {index}").alias("name"), F.lit(True).alias("enabled"),
        now.alias("createdAt"), now.alias("updatedAt"), pick("land", area).cast("string").alias("mode"), pick(max(0.0, water + 80), area).cast("double").alias("elevation"),
        pick(80.0, area).cast("double").alias("noiseScale"), pick(0.0, area).cast("double").alias("priority"), pick(220.0, not area).cast("double").alias("height"),
        pick(550.0, not area).cast("double").alias("width"), F.lit(None).cast("string").alias("fieldId"), F.lit(120.0 if area else 180.0).alias("edgeSmoothness"),
        F.lit(shapes.SMOOTHNESS).alias("splineSmoothness"), "anchors",
    )


def input_hash(config: DataFrame, primitives_json: str, water: float) -> DataFrame:
    """id, hash: FNV-1a over the config, the water level and the primitives as JSON; field graphs are no part of it."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    parts = [F.concat(F.lit('{"config":{"id":'), F.concat(F.lit('"'), F.col("id"), F.lit('"')))]
    parts += [F.concat(F.lit(f',"{c}":'), number(F.col(c))) for c in ("tileSize", "tilesPerSide", "unitSize", "worldHeight")]
    level = str(int(water)) if float(water).is_integer() else repr(float(water))
    return config.select("id", fnv1a(F.concat(*parts, F.lit(f'}},"waterLevel":{level},"primitives":{primitives_json}}}'))).alias("hash"))


def bake_record(spark: SparkSession, started: str, status: str, digest: str, primitives: int, tiles: int, error: str | None = None) -> DataFrame:
    """One row of the audit table; a failed bake has no completion and carries its error."""
    done = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return spark.range(1).select(
        F.uuid().alias("id"), F.lit(started).alias("startedAt"), done.alias("completedAt"), F.lit(status).alias("status"), F.lit(digest).alias("inputHash"),
        F.lit(primitives).alias("primitiveCount"), F.lit(tiles).alias("tileCount"), F.lit(error).cast("string").alias("error"),
    )


def type_counts(primitives: DataFrame) -> DataFrame:
    """type, n, n_enabled."""
    return primitives.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("n_enabled"))
