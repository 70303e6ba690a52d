"""Tile keys (x, y, d) and the projections between tiles, samples and the world."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import clamp, half_up, num

# Feet per unit, units per meter, and the feet of a mile.
FEET_PER_UNIT = {"foot": 1.0, "meter": 3.280839895, "cm": 0.03280839895}
UNITS_PER_METER = {"foot": 3.280839895, "meter": 1.0, "cm": 100.0}
MILE = 5280.0
# Bits of x and of x and y together in a packed key.
KEY_X, KEY_XY = 32768, 1073741824


def tile_id(x: Column, y: Column, d: Column) -> Column:
    return F.format_string("d%d/y%d/x%d", d.cast("int"), y.cast("int"), x.cast("int"))


def tile_path(x: Column, y: Column, d: Column, extension: str = "r16") -> Column:
    return F.format_string(f"tiles/d%d/y%d/x%d.{extension}", d.cast("int"), y.cast("int"), x.cast("int"))


def tile_number(x: Column, y: Column, d: Column) -> Column:
    return d.cast("bigint") * KEY_XY + y.cast("bigint") * KEY_X + x.cast("bigint")


def tiles_at(tiles_per_side: Column, d: Column) -> Column:
    return (tiles_per_side / F.pow(F.lit(2.0), d)).cast("int")


def parent(x: Column, y: Column, d: Column) -> list[Column]:
    return [F.shiftright(x.cast("int"), 1).alias("x"), F.shiftright(y.cast("int"), 1).alias("y"), (d + 1).cast("int").alias("d")]


def children(x: Column, y: Column, d: Column) -> Column:
    """The four children in the order north-west, north-east, south-west, south-east; none at depth 0."""
    four = [F.struct((x * 2 + i).cast("int").alias("x"), (y * 2 + j).cast("int").alias("y"), (d - 1).cast("int").alias("d")) for j in (0, 1) for i in (0, 1)]
    return F.when(d > 0, F.array(*four)).otherwise(F.filter(F.array(*four), lambda _: F.lit(False)))


def is_power_of_two(v: Column) -> Column:
    """True for the integers 1, 2, 4, ...; a fraction, zero or a negative number is none."""
    whole = v.cast("bigint")
    return F.coalesce((v == whole) & (whole > 0) & (whole.bitwiseAND(whole - 1) == 0), F.lit(False))


def max_depth(tiles_per_side: int) -> int:
    """Levels above depth 0, for a power of two; else an error."""
    if tiles_per_side < 1 or tiles_per_side & (tiles_per_side - 1):
        raise ValueError("LOD depth requires a power-of-two tile count.")
    return int(math.log2(tiles_per_side))


def lod_tile_count(tiles_per_side: Column) -> Column:
    """Tiles above depth 0: n^2/4 + n^2/16 + ... + 1, in closed form."""
    return ((tiles_per_side.cast("bigint") * tiles_per_side - 1) / 3).cast("bigint")


def valid_key(x: Column, y: Column, d: Column, tiles_per_side: int) -> Column:
    """Whether a key names a tile: d in the pyramid, x and y inside its level."""
    side = F.floor(F.lit(tiles_per_side) / F.pow(F.lit(2.0), d))
    return (d >= 0) & (d <= max_depth(tiles_per_side)) & (x >= 0) & (y >= 0) & (x < side) & (y < side)


def checked_keys(keys: DataFrame, tiles_per_side: int) -> DataFrame:
    """keys as they are; a key outside the pyramid fails the query that reads it."""
    ok = F.assert_true(valid_key(F.col("x"), F.col("y"), F.col("d"), tiles_per_side), F.concat(F.lit("Invalid tile key "), tile_id(F.col("x"), F.col("y"), F.col("d"))))
    return keys.where(ok.isNull())


def ancestors(keys: DataFrame, tiles_per_side: int) -> DataFrame:
    """Every ancestor of every key, once: depths d + 1 to the root."""
    up = keys.where(F.col("d") < max_depth(tiles_per_side)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_depth(tiles_per_side)) - F.col("d"))))
    return up.select(F.expr("shiftright(x, k)").alias("x"), F.expr("shiftright(y, k)").alias("y"), (F.col("d") + F.col("k")).alias("d")).distinct()


def sample_to_world(tile: Column, sample: Column, tile_size: int, tiles_per_side: int, unit: float) -> Column:
    """World coordinate of a sample; the world is centred on 0."""
    return (tile * tile_size + sample) * num(unit) - num(tile_size * tiles_per_side * unit / 2)


def world_to_sample(world: Column, tile_size: int, tiles_per_side: int, unit: float) -> tuple[Column, Column]:
    """Tile index and place inside it; the last sample is approached to a thousandth."""
    pixel = F.least(num(tile_size * tiles_per_side - 1.001), (world + num(tile_size * tiles_per_side * unit / 2)) / num(unit))
    tile = F.floor(pixel / tile_size)
    return tile.cast("int"), pixel - tile * tile_size


def sample_range(low: Column, high: Column, tile: Column, tile_size: int, tiles_per_side: int, unit: float) -> tuple[Column, Column]:
    """First and last sample of a tile inside [low, high] of the world; empty if the first is above the last."""
    half = num(tile_size * tiles_per_side * unit / 2)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((low + half) / num(unit) - tile * tile_size))
    last = F.least(F.lit(tile_size - 1).cast("bigint"), F.floor((high + half) / num(unit) - tile * tile_size))
    return first, last


def linear_size(tile_size: Column, tiles_per_side: Column, unit_size: Column) -> Column:
    return tile_size.cast("double") * tiles_per_side * unit_size


def _per(table: dict[str, float], unit: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), unit)


def area_square_miles(tile_size: Column, tiles_per_side: Column, unit_size: Column, unit: Column) -> Column:
    side = linear_size(tile_size, tiles_per_side, unit_size) * _per(FEET_PER_UNIT, unit) / MILE
    return side * side


def meters_to_units(meters: Column, unit: Column) -> Column:
    return meters * _per(UNITS_PER_METER, unit)


def to_elevation(sample: Column, world_height) -> Column:
    return sample / F.lit(65535.0) * num(world_height)


def to_sample(elevation: Column, world_height) -> Column:
    """Elevation quantized to 16 bits, halves upwards."""
    return half_up(clamp(elevation, 0, world_height) / num(world_height) * 65535.0).cast("int")


def topo_color(height01: Column) -> list[Column]:
    """r, g, b of the two-segment colour ramp, components in [0, 1]."""
    # The ramp's colours #173824, #5aa36e, #e4f6bc and where its segments meet.
    low, mid, high, split = (0x17, 0x38, 0x24), (0x5A, 0xA3, 0x6E), (0xE4, 0xF6, 0xBC), 0.62
    t = clamp(height01, 0, 1)

    def part(k: int) -> Column:
        a, b, c = low[k] / 255, mid[k] / 255, high[k] / 255
        return F.when(t < split, a + (b - a) * (t / split)).otherwise(b + (c - b) * ((t - split) / (1 - split)))

    return [part(k).alias(n) for k, n in enumerate("rgb")]
