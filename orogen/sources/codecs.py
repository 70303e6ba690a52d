"""Tile codecs: raw little-endian 16-bit samples and 16-bit grayscale PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the signature of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_samples(values) -> bytes:
    return np.asarray(values, "<u2").tobytes()


def decode_samples(data: bytes, tile_size: int) -> np.ndarray:
    """Samples in row order; an error unless there are exactly tile_size squared of them."""
    if len(data) != 2 * tile_size**2:
        raise ValueError(f"Invalid R16 payload: expected {2 * tile_size**2} bytes, got {len(data)}.")
    return np.frombuffer(data, "<u2")


def png_gray16(width: int, height: int, values) -> bytes:
    """A PNG of 16-bit grayscale without row filters; an error unless there are width x height samples."""
    samples = np.asarray(values)
    if samples.size != width * height:
        raise ValueError("PNG sample count does not match its size.")

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.zeros((height, 1 + 2 * width), "u1")
    lines[:, 1:] = samples.reshape(height, width).astype(">u2").view("u1").reshape(height, 2 * width)
    header = struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def pack_tiles(samples: DataFrame, tile_size: int) -> DataFrame:
    """Samples in long form (d, gy, gx, h) to tiles (d, y, x, data): one task holds one tile at a time. Absent samples are 0."""
    at = [F.expr(f"gy div {tile_size}").cast("int").alias("y"), F.expr(f"gx div {tile_size}").cast("int").alias("x")]
    rows = samples.select("d", *at, F.expr(f"(gy % {tile_size}) * {tile_size} + gx % {tile_size}").cast("int").alias("i"), "h")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(tile_size**2, "<u2")
        out[pdf["i"].to_numpy()] = pdf["h"].to_numpy()
        return pd.DataFrame({"d": [key[0]], "y": [key[1]], "x": [key[2]], "data": [out.tobytes()]})

    return rows.groupBy("d", "y", "x").applyInPandas(pack, "d int, y int, x int, data binary")


def unpack_tiles(tiles: DataFrame, tile_size: int) -> DataFrame:
    """The inverse of pack_tiles, every sample a row; a payload of another length fails the query."""

    def unpack(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                h = decode_samples(row.data, tile_size)
                sy, sx = np.divmod(np.arange(tile_size**2), tile_size)
                yield pd.DataFrame({"d": row.d, "gy": row.y * tile_size + sy, "gx": row.x * tile_size + sx, "h": h.astype("i4")})

    return tiles.select("d", "y", "x", "data").mapInPandas(unpack, "d int, gy int, gx int, h int")


def as_png(tiles: DataFrame, tile_size: int) -> DataFrame:
    """Tiles with their data as PNG."""

    def convert(batches):
        for pdf in batches:
            yield pdf.assign(data=[png_gray16(tile_size, tile_size, decode_samples(x, tile_size)) for x in pdf["data"]])

    return tiles.select("d", "y", "x", "data").mapInPandas(convert, "d int, y int, x int, data binary")
