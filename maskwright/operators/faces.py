"""Face detection behind a model: anchors of all strides to boxes in the image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import geometry as G


def detected(anchors: DataFrame, width: int, height: int, side: int, image: str = "image_id") -> DataFrame:
    """``anchors`` (image, id, stride, idx, cls, obj, reg) of a model with ``side`` x ``side`` input: image, id, score, box.

    Anchors are decoded by their stride, those under ``SCORE_AT`` dropped, the
    others suppressed image by image, and what stays is mapped back through the
    letterbox.  Anchors of another stride are ignored.  Only anchors that pass
    the score are gathered, an image's at most.
    """
    decode = lambda s: G.decoded(F.col("idx"), F.col("cls"), F.col("obj"), F.col("reg"), s, side)
    by_stride = reduce(lambda c, s: c.when(F.col("stride") == s, decode(s)), G.STRIDES[1:], F.when(F.col("stride") == G.STRIDES[0], decode(G.STRIDES[0])))
    sure = anchors.select(image, "id", by_stride.alias("d")).where(F.col("d.score") >= G.SCORE_AT).select(image, F.struct("id", "d.score", "d.box").alias("c"))
    kind = dict(sure.dtypes)["c"]
    kept = sure.groupBy(image).agg(F.collect_list("c").alias("c")).select(image, F.explode(G.suppressed(F.col("c"), G.NMS_AT, kind)).alias("k"))
    fit = G.letterbox(F.lit(width), F.lit(height), side)
    return kept.select(image, F.col("k.id").alias("id"), F.col("k.score").alias("score"), G.image_box(F.col("k.box"), fit, F.lit(width), F.lit(height)).alias("box"))
