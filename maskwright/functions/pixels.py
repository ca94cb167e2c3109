"""Row-major RGBA pixels: masking, its proof, and a face model's input tensor.

Null images, sizes or boxes give null; null boxes in a list paint nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.geometry import MASK_COLOUR

BOXES = "array<struct<x:int,y:int,w:int,h:int>>"


def _image(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def _cut(b: dict, width: int, height: int) -> tuple[slice, slice]:
    x, y = max(0, b["x"]), max(0, b["y"])
    return slice(y, max(y, min(height, b["y"] + b["h"]))), slice(x, max(x, min(width, b["x"] + b["w"])))


def masked(pixels: Column, width: Column, height: Column, boxes: Column) -> Column:
    """The image with (already padded) boxes painted over."""

    @F.arrow_udf("binary")
    def run(p: pa.Array, w: pa.Array, h: pa.Array, bs: pa.Array) -> pa.Array:
        out = []
        for data, wide, high, boxes in zip(p.to_pylist(), w.to_pylist(), h.to_pylist(), bs.to_pylist(), strict=True):
            if data is None or wide is None or high is None:
                out.append(None)
                continue
            image = _image(data, wide, high).copy()
            for b in filter(None, boxes or []):
                image[_cut(b, wide, high)] = (*MASK_COLOUR, 255)
            out.append(image.tobytes())
        return pa.array(out, pa.binary())

    return run(pixels, width, height, boxes)


def fully_masked(pixels: Column, width: Column, height: Column, box: Column) -> Column:
    """Every pixel of the box lies in the image and has the mask's colour."""

    @F.arrow_udf("boolean")
    def run(p: pa.Array, w: pa.Array, h: pa.Array, bs: pa.Array) -> pa.Array:
        out = []
        for data, wide, high, b in zip(p.to_pylist(), w.to_pylist(), h.to_pylist(), bs.to_pylist(), strict=True):
            if data is None or wide is None or high is None or b is None:
                out.append(None)
                continue
            inside = b["x"] >= 0 and b["y"] >= 0 and b["x"] + b["w"] <= wide and b["y"] + b["h"] <= high
            empty = b["w"] <= 0 or b["h"] <= 0
            out.append(empty or (inside and bool((_image(data, wide, high)[_cut(b, wide, high)][..., :3] == MASK_COLOUR).all())))
        return pa.array(out, pa.bool_())

    return run(pixels, width, height, box)


def cut_out(pixels: Column, width: Column, height: Column, box: Column) -> Column:
    """The pixels of a box; null if it doesn't lie within the image or is empty."""

    @F.arrow_udf("binary")
    def run(p: pa.Array, w: pa.Array, h: pa.Array, bs: pa.Array) -> pa.Array:
        out = []
        for data, wide, high, b in zip(p.to_pylist(), w.to_pylist(), h.to_pylist(), bs.to_pylist(), strict=True):
            if None in (data, wide, high, b) or b["w"] <= 0 or b["h"] <= 0 or b["x"] < 0 or b["y"] < 0 or b["x"] + b["w"] > wide or b["y"] + b["h"] > high:
                out.append(None)
            else:
                out.append(np.ascontiguousarray(_image(data, wide, high)[_cut(b, wide, high)]).tobytes())
        return pa.array(out, pa.binary())

    return run(pixels, width, height, box)


def tensor(data: bytes, width: int, height: int, side: int) -> np.ndarray:
    """Letterboxed planes of blue, green and red, by nearest neighbours."""
    scale = min(side / width, side / height)
    left, top = int((side - width * scale) // 2), int((side - height * scale) // 2)
    wide, high = int(width * scale + 0.5), int(height * scale + 0.5)
    rows = np.minimum(height - 1, np.floor(np.arange(high) / scale).astype(int))
    columns = np.minimum(width - 1, np.floor(np.arange(wide) / scale).astype(int))
    out = np.zeros((3, side, side), np.float32)
    out[:, top : top + high, left : left + wide] = _image(data, width, height)[rows][:, columns, 2::-1].transpose(2, 0, 1)
    return out


def model_input(pixels: Column, width: Column, height: Column, side: int) -> Column:
    """The tensor as a flat array."""

    @F.arrow_udf("array<float>")
    def run(p: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        rows = zip(p.to_pylist(), w.to_pylist(), h.to_pylist(), strict=True)
        return pa.array([None if None in x else tensor(*x, side).ravel() for x in rows], pa.list_(pa.float32()))

    return run(pixels, width, height)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 8-bit channels."""
    part = lambda c: F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    return part(r) * 0.2126 + part(g) * 0.7152 + part(b) * 0.0722


def contrast(one: Column, two: Column) -> Column:
    return (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)
