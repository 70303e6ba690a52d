"""Primitives as geometry: smoothed outlines, segments, bounds, containment, distances and weights.

A primitives table has id, ord (place in the document), type ('landformArea' or 'mountainSpline'),
enabled, anchors (array of id, x, z) and the numbers of its type; see schema.PRIMITIVE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import once
from ..functions.scalars import EPSILON, bind, clamp, num, smoothstep

# Default smoothness, longest straight step, least steps per segment.
SMOOTHNESS, STEP, LEAST_STEPS = 0.65, 80.0, 4
AREA, SPLINE = "landformArea", "mountainSpline"


def _catmull(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
    return 0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t * t + (3 * b - a - 3 * c + d) * t * t * t)


def spline_points(anchors: Column, closed: Column, smoothness: Column) -> Column:
    """Outline through the anchors as array of (x, z, segment).

    Each pair of neighbours is one segment of at least four steps of at most 80 units along a Catmull-Rom
    curve, drawn towards the straight line as smoothness falls. Fewer than three anchors, or smoothness 0 or less:
    the anchors themselves. Missing smoothness is 0.65.
    """
    s, n = F.coalesce(smoothness, F.lit(SMOOTHNESS)), F.size(anchors)

    def anchor(i: Column) -> Column:
        return F.get(anchors, F.when(closed, F.pmod(i + n, n)).otherwise(F.greatest(F.lit(0), F.least(i, n - 1))))

    def segment(i: Column) -> Column:
        four = F.struct(*[anchor(i + k).alias(name) for k, name in zip((-1, 0, 1, 2), "abcd", strict=True)])
        return bind(four, lambda q: bind(F.greatest(F.lit(LEAST_STEPS), F.ceil(F.hypot(q["c"]["x"] - q["b"]["x"], q["c"]["z"] - q["b"]["z"]) / STEP).cast("int")), lambda n: curve_points(i, q, n)))

    def curve_points(i: Column, q: Column, steps: Column) -> Column:
        def point(k: Column) -> Column:
            def place(t: Column) -> Column:
                out = []
                for axis in "xz":
                    a, b, c, d = (q[p][axis] for p in "abcd")
                    line = b + (c - b) * t
                    out.append((line + (_catmull(a, b, c, d, t) - line) * clamp(s, 0, 1)).alias(axis))
                return F.struct(*out, i.cast("int").alias("segment"))

            return bind(k / steps, place)

        return F.transform(F.sequence(F.when(i > 0, 1).otherwise(0), steps - 1), point)

    last = F.get(anchors, n - 1)
    end = F.array(F.struct(last["x"].alias("x"), last["z"].alias("z"), (n - 2).cast("int").alias("segment")))
    curve = F.flatten(F.transform(F.sequence(F.lit(0), F.when(closed, n).otherwise(n - 1) - 1), segment))
    raw = F.transform(
        anchors, lambda p, i: F.struct(p["x"].alias("x"), p["z"].alias("z"), F.when(closed, i).otherwise(F.least(i, F.greatest(F.lit(0), n - 2))).cast("int").alias("segment"))
    )
    return F.when((n < 3) | (s <= 0), raw).otherwise(F.when(closed, curve).otherwise(F.concat(curve, end)))


def segments_of(points: Column, closed: Column) -> Column:
    """Neighbouring points as array of (ax, az, bx, bz, length, minx, maxx, minz, maxz); a closed outline ends with the step to its start."""
    def pair(a: Column, b: Column) -> Column:
        return F.struct(
            a["x"].alias("ax"), a["z"].alias("az"), b["x"].alias("bx"), b["z"].alias("bz"), F.hypot(b["x"] - a["x"], b["z"] - a["z"]).alias("length"),
            F.least(a["x"], b["x"]).alias("minx"), F.greatest(a["x"], b["x"]).alias("maxx"), F.least(a["z"], b["z"]).alias("minz"), F.greatest(a["z"], b["z"]).alias("maxz"),
        )

    def pairs(p: Column) -> Column:
        after = F.concat(F.slice(p, F.lit(2), F.size(p)), F.slice(p, F.lit(1), F.lit(1)))
        every = F.zip_with(p, after, pair)
        return F.when(closed, every).otherwise(F.slice(every, F.lit(1), F.greatest(F.lit(0), F.size(p) - 1)))

    return bind(points, pairs)


def running_lengths(prepared: DataFrame) -> DataFrame:
    """id, i, length, start: each segment's length and the length along the outline before it."""
    from pyspark.sql import Window

    rows = prepared.select("id", F.posexplode("segments").alias("i", "s")).select("id", "i", "s.length")
    before = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0.0)))


def usable() -> Column:
    """Enabled areas of three anchors and splines of two."""
    least = F.when(F.col("type") == AREA, 3).when(F.col("type") == SPLINE, 2)
    return F.col("enabled") & (F.size("anchors") >= least)


def prepare(primitives: DataFrame) -> DataFrame:
    """Usable primitives with points, segments and bounds (minx, maxx, minz, maxz; splines padded by half their width)."""
    area = F.col("type") == AREA
    out = once(primitives.where(usable()), points=spline_points(F.col("anchors"), area, F.col("splineSmoothness")))
    pad = F.when(area, F.lit(0.0)).otherwise(F.col("width") / 2)
    box = {f"min{a}": F.array_min(F.col("points")[a]) - pad for a in "xz"} | {f"max{a}": F.array_max(F.col("points")[a]) + pad for a in "xz"}
    return once(out, segments=segments_of(F.col("points"), area), **box)


def inside(x: Column, z: Column, segments: Column) -> Column:
    """Even-odd containment in a closed outline; on the half-open crossing rule a border point counts on one side only."""

    def crosses(s: Column) -> Column:
        rise = s["az"] - s["bz"]
        at = (s["ax"] - s["bx"]) * (z - s["bz"]) / F.when(rise == 0, F.lit(EPSILON)).otherwise(rise) + s["bx"]
        return ((s["bz"] > z) != (s["az"] > z)) & (x < at)

    return F.size(F.filter(segments, crosses)) % 2 == 1


def segment_distance2(x: Column, z: Column, s: Column) -> Column:
    """Squared distance from a point to a segment; a segment of no length is a point."""
    dx, dz = s["bx"] - s["ax"], s["bz"] - s["az"]
    along = ((x - s["ax"]) * dx + (z - s["az"]) * dz) / F.nullif(dx * dx + dz * dz, F.lit(0.0))
    t = F.when(along.isNull(), num(0)).otherwise(F.greatest(num(0), F.least(num(1), along)))
    gap = bind(t, lambda t: F.struct((x - (s["ax"] + dx * t)).alias("x"), (z - (s["az"] + dz * t)).alias("z")))
    return bind(gap, lambda g: g["x"] * g["x"] + g["z"] * g["z"])


def distance(x: Column, z: Column, segments: Column, most: Column | None = None) -> Column:
    """Distance to the nearest segment; beyond `most` it is most + 1, and segments whose box is farther are not worked out."""
    near = segments
    if most is not None:
        near = F.filter(segments, lambda s: (x >= s["minx"] - most) & (x <= s["maxx"] + most) & (z >= s["minz"] - most) & (z <= s["maxz"] + most))
    found = F.sqrt(F.array_min(F.transform(near, lambda s: segment_distance2(x, z, s))))
    return found if most is None else bind(found, lambda d: F.when(d <= most, d).otherwise(most + 1))


def area_weight(x: Column, z: Column, segments: Column, edge: Column) -> Column:
    """0 outside, 1 inside, and a smooth ramp over `edge` from the outline inwards."""
    ramp = F.when(edge <= 0, F.lit(1.0)).otherwise(bind(distance(x, z, segments, edge), lambda d: smoothstep(0, edge, d)))
    return F.when(inside(x, z, segments), ramp).otherwise(F.lit(0.0))


def spline_weight(x: Column, z: Column, segments: Column, width: Column, edge: Column) -> Column:
    """1 along the spline, falling smoothly over `edge` to 0 at half the width; edge 0 falls along a line."""
    half = width / 2
    soft = clamp(edge, 0, half)
    full = F.greatest(num(0), half - soft)

    def fade(d: Column) -> Column:
        inner = F.when(soft == 0, 1 - d / F.nullif(half, F.lit(0.0))).when(d <= full, F.lit(1.0)).otherwise(1 - smoothstep(full, half, d))
        return F.when(d >= half, F.lit(0.0)).otherwise(inner)

    return F.when(width <= 0, F.lit(0.0)).otherwise(bind(distance(x, z, segments, half), fade))


def weight(x: Column, z: Column) -> Column:
    """The weight of a prepared primitive at a point, by its type."""
    s, edge = F.col("segments"), F.col("edgeSmoothness")
    return F.when(F.col("type") == AREA, area_weight(x, z, s, edge)).otherwise(spline_weight(x, z, s, F.col("width"), edge))


def holds(x: Column, z: Column) -> Column:
    """Closed box test against a prepared primitive's bounds."""
    return x.between(F.col("minx"), F.col("maxx")) & z.between(F.col("minz"), F.col("maxz"))


def corridor(points: Column, radius: Column) -> Column:
    """The outline at `radius` on both sides of a line: left side onwards, right side back. Points whose neighbours coincide are passed over."""
    n = F.size(points)

    def side(sign: int) -> Column:
        def offset(p: Column, i: Column) -> Column:
            a, b = F.get(points, F.greatest(F.lit(0), i - 1)), F.get(points, F.least(n - 1, i + 1))
            dx, dz = b["x"] - a["x"], b["z"] - a["z"]
            size = F.nullif(F.hypot(dx, dz), F.lit(0.0))
            moved = F.struct((p["x"] - sign * dz / size * radius).alias("x"), (p["z"] + sign * dx / size * radius).alias("z"))
            return F.when(size.isNotNull(), moved)

        return F.array_compact(F.transform(points, offset))

    return F.concat(side(1), F.reverse(side(-1)))


def target_elevation(mode: Column, elevation: Column, water: float, height: float) -> Column:
    """Water areas stay below the water level, others above it; inside [0, height]."""
    return clamp(F.when(mode == "water", F.least(elevation, num(water - 1))).otherwise(F.greatest(elevation, num(water + 1))), 0, height)
