"""PNG images: 8-bit grey, RGB and RGBA, not interlaced, to row-major RGBA and back."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: its signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(rgba: bytes, width: int, height: int) -> bytes:
    """An RGBA image, every row filtered by its difference from the row above."""
    rows = np.frombuffer(rgba, np.uint8).reshape(height, width * 4)
    up = rows - np.vstack([np.zeros((1, width * 4), np.uint8), rows[:-1]])
    lines = np.hstack([np.full((height, 1), 2, np.uint8), up])
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        yield kind, body
        at += 12 + size


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filter of each row; ``step`` bytes are a pixel."""
    above = np.zeros(lines.shape[1] - 1, np.uint8)
    out = np.empty((len(lines), lines.shape[1] - 1), np.uint8)
    for i, line in enumerate(lines):
        kind, row = line[0], line[1:]
        if kind == 0:
            now = row
        elif kind == 1:
            now = np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            now = row + above
        elif kind in (3, 4):
            now = np.zeros_like(row)
            for j in range(len(row)):
                left, corner = (int(now[j - step]), int(above[j - step])) if j >= step else (0, 0)
                b = int(above[j])
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
                now[j] = (int(row[j]) + guess) & 255
        else:
            raise ValueError("an unknown filter")
        out[i] = above = now
    return out


def decode(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA pixels; ``ValueError`` for what isn't such an image."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    head, body = None, []
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("not an 8-bit grey, RGB or RGBA image")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (width * n + 1):
        raise ValueError("an image is cut short")
    pixels = _unfiltered(raw.reshape(height, width * n + 1), n).reshape(height, width, n)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = pixels[..., :3] if n > 1 else pixels
    if n == 4:
        out[..., 3] = pixels[..., 3]
    return width, height, out.tobytes()


def encoded(pixels: Column, width: Column, height: Column) -> Column:
    """The PNG of RGBA pixels; null for nulls."""

    @F.arrow_udf("binary")
    def run(p: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        rows = zip(p.to_pylist(), w.to_pylist(), h.to_pylist(), strict=True)
        return pa.array([None if None in x else encode(*x) for x in rows], pa.binary())

    return run(pixels, width, height)


def decoded(data: Column) -> Column:
    """``struct<width, height, rgba>`` of a PNG; null for nulls and for what isn't one."""
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())])

    @F.arrow_udf("struct<width:int,height:int,rgba:binary>")
    def run(images: pa.Array) -> pa.Array:
        out = []
        for x in images.to_pylist():
            try:
                out.append(None if x is None else dict(zip(("width", "height", "rgba"), decode(x), strict=True)))
            except (ValueError, zlib.error, struct.error):
                out.append(None)
        return pa.array(out, kind)

    return run(data)


def scan_png(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder: path, width, height, rgba. Files that aren't such images are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return rows.select("path", decoded(F.col("content")).alias("i")).where("i IS NOT NULL").select("path", "i.*")
