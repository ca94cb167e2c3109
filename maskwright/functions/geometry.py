"""Boxes: overlap, padding, letterboxing, decoding, suppression.

A box is ``struct<x, y, w, h>``.  ``js_round`` rounds halves up, as browsers do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PADDING = 0.1
# The mask colour and the face model's strides and thresholds.
MASK_COLOUR = (40, 44, 52)
STRIDES = (8, 16, 32)
SCORE_AT, NMS_AT = 0.4, 0.3


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    side = lambda at, size: F.greatest(F.lit(0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
    both = (side("x", "w") * side("y", "h")).cast("double")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def padded(b: Column, width: Column, height: Column) -> Column:
    """The box with a tenth of its size on each side, within the image."""
    pad_x, pad_y = js_round(b["w"] * PADDING), js_round(b["h"] * PADDING)
    left, top = F.greatest(F.lit(0), b["x"] - pad_x), F.greatest(F.lit(0), b["y"] - pad_y)
    return box(left, top, F.least(width - left, b["w"] + pad_x * 2), F.least(height - top, b["h"] + pad_y * 2))


def painted(b: Column, width: Column, height: Column) -> Column:
    """Pixels that masking a padded box paints."""
    p = padded(b, width, height)
    side = lambda at, size, limit: F.greatest(F.lit(0), F.least(p[at] + p[size], limit) - F.greatest(p[at], F.lit(0)))
    return side("x", "w", width) * side("y", "h", height)


def letterbox(width: Column, height: Column, side: int) -> Column:
    """Scale and offsets that fit an image into a square."""
    scale = F.least(side / width, side / height)
    return F.struct(scale.alias("scale"), F.floor((side - width * scale) / 2).alias("offset_x"), F.floor((side - height * scale) / 2).alias("offset_y"))


def decoded(index: Column, cls: Column, obj: Column, reg: Column, stride: int, side: int) -> Column:
    """Score and box of one anchor of a stride, in model coordinates; ``reg`` is an array of four."""
    columns = side // stride
    x = (index % columns + reg[0]) * stride
    y = (F.floor(index / columns) + reg[1]) * stride
    w, h = F.exp(reg[2]) * stride, F.exp(reg[3]) * stride
    score = F.sqrt(F.greatest(F.lit(0.0), cls) * F.greatest(F.lit(0.0), obj))
    return F.struct(score.alias("score"), box(x - w / 2, y - h / 2, w, h).alias("box"))


def image_box(b: Column, fit: Column, width: Column, height: Column) -> Column:
    """A model-space box in the image's own pixels, clamped and rounded."""
    clamp = lambda x, limit: F.greatest(F.lit(0.0), F.least(limit.cast("double"), x))
    left, right = clamp((b["x"] - fit["offset_x"]) / fit["scale"], width), clamp((b["x"] + b["w"] - fit["offset_x"]) / fit["scale"], width)
    top, bottom = clamp((b["y"] - fit["offset_y"]) / fit["scale"], height), clamp((b["y"] + b["h"] - fit["offset_y"]) / fit["scale"], height)
    return box(js_round(left), js_round(top), js_round(right - left), js_round(bottom - top))


def suppressed(candidates: Column, threshold: float = NMS_AT, kind: str = "struct<id:bigint,score:double,box:struct<x:bigint,y:bigint,w:bigint,h:bigint>>") -> Column:
    """Greedy non-maximum suppression of ``array<struct<id, score, box>>``: best score first, then smallest id."""
    keyed = F.array_sort(F.transform(candidates, lambda c: F.struct((-c["score"]).alias("k"), c["id"].alias("id"), c.alias("c"))))
    return F.aggregate(
        F.transform(keyed, lambda k: k["c"]),
        F.array().cast(f"array<{kind}>"),
        lambda kept, c: F.when(F.exists(kept, lambda o: iou(o["box"], c["box"]) >= threshold), kept).otherwise(F.concat(kept, F.array(c))),
    )

