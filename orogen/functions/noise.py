"""Seeded simplex noise in two dimensions: vectorized in numpy, served as an Arrow-batched UDF."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

U32 = 0xFFFFFFFF
# Skew constants of the simplex grid, and its twelve gradient directions.
F2, G2 = 0.3660254037844386, 0.21132486540518713
GRADIENTS = np.array([(1, 1), (-1, 1), (1, -1), (-1, -1), (1, 0), (-1, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (0, 1), (0, -1)], "f8")


def prng(seed: int, n: int) -> list[float]:
    """n numbers in [0, 1) of the additive generator with two xor-multiply rounds; seed 0 counts as 1."""
    # The increment, shifts and odd masks of the generator.
    state, out = (seed & U32) or 1, []
    for _ in range(n):
        state = (state + 0x6D2B79F5) & U32
        v = ((state ^ state >> 15) * (state | 1)) & U32
        v ^= (v + ((v ^ v >> 7) * (v | 61) & U32)) & U32
        out.append((v ^ v >> 14) / 2**32)
    return out


@lru_cache(maxsize=256)
def permutation(seed: int) -> np.ndarray:
    """512 entries: a shuffled 0..255, twice."""
    table = list(range(256))
    for i, r in enumerate(prng(seed, 255)):
        j = i + int(r * (256 - i))
        table[i], table[j] = table[j], table[i]
    return np.array(table * 2, "i8")


def simplex2(seed: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Noise in [-1, 1] at each point; a point that is not finite gives NaN."""
    table = permutation(seed)
    fine = np.isfinite(x) & np.isfinite(y)
    if not fine.all():
        out = np.full(len(x), np.nan)
        out[fine] = simplex2(seed, x[fine], y[fine])
        return out
    s = (x + y) * F2
    i, j = np.floor(x + s), np.floor(y + s)
    t = (i + j) * G2
    x0, y0 = x - (i - t), y - (j - t)
    right = x0 > y0
    i, j = np.mod(i, 256).astype("i8"), np.mod(j, 256).astype("i8")
    out = np.zeros(len(x))
    for di, dj, dx, dy in ((0, 0, x0, y0), (right * 1, ~right * 1, x0 - right + G2, y0 - ~right + G2), (1, 1, x0 - 1 + 2 * G2, y0 - 1 + 2 * G2)):
        g = GRADIENTS[table[i + di + table[j + dj]] % 12]
        near = np.maximum(0.5 - dx * dx - dy * dy, 0)
        out += near**4 * (g[:, 0] * dx + g[:, 1] * dy)
    return 70 * out


def simplex_column(seed: int, x: Column, y: Column) -> Column:
    """simplex2 at (x, y) as a column; one Arrow batch per call, null where either is null."""

    @F.pandas_udf(DoubleType())
    def at(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(simplex2(seed, a.to_numpy("f8", na_value=np.nan), b.to_numpy("f8", na_value=np.nan)))

    return at(x.cast("double"), y.cast("double"))


# Fixed value: from one octave's seed to the next one's.
OCTAVE_SEED = 1013


def fractal_column(seed: int, x: Column, y: Column, octaves: int, frequency: float, lacunarity: float, gain: float, skew: tuple[float, float], offset: tuple[float, float], ridged: bool) -> Column:
    """The weighted mean of an fBM's octaves, all in one UDF call so that points cross to Python once."""

    @F.pandas_udf(DoubleType())
    def at(a: pd.Series, b: pd.Series) -> pd.Series:
        px, py = a.to_numpy("f8", na_value=np.nan) + offset[0], b.to_numpy("f8", na_value=np.nan) + offset[1]
        total, weight, f, w = np.zeros(len(px)), 0.0, frequency, 1.0
        for k in range(octaves):
            n = simplex2(seed + OCTAVE_SEED * k, px * f / skew[0], py * f / skew[1])
            total += (1 - np.abs(n) if ridged else n * 0.5 + 0.5) * w
            weight, w, f = weight + w, w * gain, f * lacunarity
        return pd.Series(total / (weight or 1.0))

    return at(x.cast("double"), y.cast("double"))
