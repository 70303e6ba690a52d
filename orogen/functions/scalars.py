"""Scalar functions as Column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Double precision's machine epsilon, the 32-bit mask, the largest 16-bit sample.
EPSILON = 2.220446049250313e-16
U32 = 4294967295
SAMPLE_MAX = 65535


def num(x) -> Column:
    """A number as a double literal; a column as it is."""
    return x if isinstance(x, Column) else F.lit(float(x))


def bind(x: Column, use) -> Column:
    """use(x) with x worked out once and named once, so that nested formulas grow in a line and not by powers."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def clamp(x, low, high) -> Column:
    """x held inside [low, high]; NaN stays NaN although Spark sorts it above everything."""
    x = num(x)
    return F.when(F.isnan(x), x).otherwise(F.greatest(num(low), F.least(num(high), x)))


def lerp(a, b, t) -> Column:
    return num(a) + (num(b) - num(a)) * num(t)


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards, also below zero; as BIGINT without relying on a cast's rounding."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def finite_or(x: Column, fallback) -> Column:
    """A number read leniently: what is no finite number becomes the fallback."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), num(fallback)).otherwise(d)


def smoothstep(low, high, x: Column) -> Column:
    """The cubic ramp from low to high; a step at high if both are equal."""
    low, high = num(low), num(high)
    ramp = bind((x - low) / F.nullif(high - low, F.lit(0.0)), lambda t: ease(clamp(t, 0, 1)))
    return F.when(low == high, F.when(x >= high, 1.0).otherwise(0.0)).otherwise(ramp)


def ease(t: Column) -> Column:
    return t * t * (3 - 2 * t)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is within machine epsilon of 0."""
    return F.when(F.abs(b) <= EPSILON, F.lit(0.0)).otherwise(a / F.when(F.abs(b) <= EPSILON, F.lit(1.0)).otherwise(b))


def power(x: Column, exponent) -> Column:
    """x to the exponent, negative x taken as 0."""
    return F.pow(F.when(x > 0, x).otherwise(F.lit(0.0)), num(exponent))


def terrace(x: Column, steps: float, softness: float) -> Column:
    """Flat steps joined by smooth ramps; softness 1 leaves the clamped value as it is."""
    count, t, v = max(1, int(steps)), min(1.0, max(0.0, softness)), clamp(x, 0, 1)
    if t >= 1:
        return v

    def ramp(u: Column) -> Column:
        cell = F.least(F.lit(float(count - 1)), F.floor(u * count).cast("double"))
        low, high = cell / count, (cell + 1) / count
        return low + (high - low) * smoothstep(1 - max(t, EPSILON), 1, clamp(u * count - cell, 0, 1))

    return bind(v, ramp)


def remap(x01: Column, low, high) -> Column:
    return num(low) + x01 * (num(high) - num(low))


# --- 32-bit integer arithmetic on BIGINT ---


def u32(x) -> Column:
    x = x if isinstance(x, Column) else F.lit(int(x))
    return x.cast("bigint").bitwiseAND(F.lit(U32))


def mul32(a: Column, b: int) -> Column:
    """The low 32 bits of a product. Halves keep every step inside 64 bits, so ANSI mode never overflows."""
    b = b & U32
    a = u32(a)
    low, high = a.bitwiseAND(F.lit(65535)), F.shiftright(a, 16)
    return (low * F.lit(b) + (high * F.lit(b)).bitwiseAND(F.lit(65535)) * F.lit(65536)).bitwiseAND(F.lit(U32))


def hash2(x: Column, y: Column, seed: int) -> Column:
    """A point of an integer lattice, mixed to [0, 1]."""
    # The multipliers of the lattice hash.
    mixed = mul32(x, 374761393).bitwiseXOR(mul32(y, 668265263)).bitwiseXOR(F.lit((seed * 1442695041) & U32))
    mixed = bind(mixed, lambda h: mul32(h.bitwiseXOR(F.shiftright(h, 13)), 1274126177))
    return bind(mixed, lambda h: h.bitwiseXOR(F.shiftright(h, 16)).cast("double") / float(U32))


def value_noise(x: Column, y: Column, seed: int) -> Column:
    """Lattice hashes of the four corners around (x, y), blended smoothly."""
    place = F.struct(*[F.floor(v).cast("bigint").alias(f"{n}0") for n, v in (("x", x), ("y", y))], x.alias("x"), y.alias("y"))

    def corners(p: Column) -> Column:
        four = [hash2(p["x0"] + i, p["y0"] + j, seed).alias(f"h{i}{j}") for j in (0, 1) for i in (0, 1)]
        return F.struct(*four, ease(p["x"] - p["x0"]).alias("tx"), ease(p["y"] - p["y0"]).alias("ty"))

    def blend(q: Column) -> Column:
        sides = F.struct(lerp(q["h00"], q["h10"], q["tx"]).alias("a"), lerp(q["h01"], q["h11"], q["tx"]).alias("b"))
        return bind(sides, lambda s: lerp(s["a"], s["b"], q["ty"]))

    return bind(bind(place, corners), blend)


def rolling_height(x: Column, y: Column, seed: int = 42) -> Column:
    """Five octaves of value noise in [0, 1]."""
    # First amplitude 0.62, first frequency 0.0032, seed step 101, scale 0.86, offset 0.07.
    octaves = [(0.62 * 0.5**k, 0.0032 * 2**k, seed + 101 * k) for k in range(5)]
    total = reduce(lambda a, b: a + b, [value_noise(x * f, y * f, s) * a for a, f, s in octaves])
    return bind(total / sum(a for a, _, _ in octaves) * 0.86 + 0.07, lambda v: clamp(v, 0, 1))


def fnv1a(text: Column) -> Column:
    """FNV-1a over a string's UTF-16 units, as eight lower-case hex digits."""
    # The 32-bit FNV offset basis and prime.
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), F.length(text) * 2 - 1), lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    units = F.filter(F.when(F.length(text) > 0, units).otherwise(F.array().cast("array<bigint>")), lambda u: u.isNotNull())
    mixed = F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda h, u: mul32(h.bitwiseXOR(u), 16777619))
    return F.lower(F.lpad(F.hex(mixed), 8, "0"))
