"""The whole firewall for screens: detect, verify, resolve, tokenize, withhold, rank, project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import names, pii, verifier
from maskwright.operators import context as C
from maskwright.operators import redact as R

TITLE_CHARS = 120


def prepared(elements: DataFrame, task: Column, titles: DataFrame | None = None, score: Callable[[str, str], float] | None = None, scope: str = "scope_id", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Payload elements and page titles that may be sent.

    ``elements``: scope, order, role, text, bbox, sensitive; ``titles``: scope,
    title.  The title is the scope's last text, so it shares its tokens.
    Elements whose redaction needs review are withheld.  Returns (scope, mark_id,
    role, text, bbox) and (scope, page_ident).
    """
    columns = [scope, order, "role", "text", "bbox", "sensitive"]
    rows = elements.select(*columns, F.lit(False).alias("is_title"))
    if titles is not None:
        kinds = dict(elements.dtypes)
        last = F.lit(2**62).cast(kinds[order])
        rows = rows.unionByName(titles.select(scope, last.alias(order), F.lit(None).cast("string").alias("role"), F.col("title").alias("text"), F.lit(None).cast(kinds["bbox"]).alias("bbox"), F.lit(False).alias("sensitive"), F.lit(True).alias("is_title")))
    rows = rows.withColumn("found", pii.all_spans(F.col("text"), names.unstructured(F.col("text"))))
    if score is not None:
        rows = rows.withColumn("no", verifier.rejected(F.col("text"), F.col("found"), score)).withColumn("found", pii.without(F.col("found"), F.col("no"))).drop("no")
    rows = rows.withColumn("spans", pii.resolved(F.col("found"))).drop("found")
    clean = R.redact_scopes(rows, scope, order)
    clean = clean.withColumn("sensitive", F.coalesce("sensitive", F.lit(False)) | F.col("requires_review"))
    sent = C.marked(clean.where("NOT is_title"), task, scope, order).select(scope, "mark_id", "role", "text", "bbox")
    return sent, clean.where("is_title").select(scope, F.substring("text", 1, TITLE_CHARS).alias("page_ident"))
