"""Labelled texts and accessible nodes: what an evaluation is run on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(template: Column, values: Column) -> Column:
    """``struct<text, spans>`` of a template whose ``{slot}`` places are filled from a map of values.

    A span (start, end, type, value) tells where each value stands; ``type`` is
    the slot's name in upper case.  Slots without a value are left empty and give
    no span.
    """
    gaps, slots = F.split(template, r"\{[a-z_]+\}", -1), F.regexp_extract_all(template, F.lit(r"\{([a-z_]+)\}"), F.lit(1))
    parts = F.arrays_zip(gaps.alias("gap"), slots.alias("slot"))
    span = "struct<start:int,end:int,type:string,value:string>"

    def step(state: Column, p: Column) -> Column:
        value = F.coalesce(F.try_element_at(values, p["slot"]), F.lit(""))
        text = F.concat(state["text"], p["gap"])
        here = F.struct(F.length(text).alias("start"), (F.length(text) + F.length(value)).cast("int").alias("end"), F.upper(p["slot"]).alias("type"), value.alias("value"))
        spans = F.when(F.length(value) > 0, F.concat(state["spans"], F.array(here))).otherwise(state["spans"])
        return F.struct(F.concat(text, value).alias("text"), spans.alias("spans"))

    begin = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{span}>").alias("spans"))
    return F.aggregate(parts, begin, step)


def truth_texts(elements: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """A row a text of a screen, with the id of the label that marks it (``data-truth``-like pattern, group 1) or null; marks are taken out."""
    mark = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return elements.select(key, mark.alias("truth_id"), F.trim(F.regexp_replace(F.col(text), pattern, "")).alias("text"))


#: Roles of an accessibility tree that a user can act on or read.
LISTED = ("button", "link", "textbox", "checkbox", "radio", "combobox", "menuitem", "heading", "img")


def ax_tree(nodes: DataFrame, depth: int = 8) -> DataFrame:
    """``nodes`` (screen, id, parent, role, name, ignored, quad) to the listed ones: screen, id, role, name, box.

    A node without a name takes that of its nearest ancestor that has one and is
    not ignored, up to ``depth`` levels; a node under an ignored one of the
    same screen counts as long as it isn't ignored itself.  The box of a quad (8
    numbers) is that of its extreme corners; nodes without an area go.
    """
    up = nodes.select(F.col("screen").alias("s"), F.col("id").alias("up"), F.col("parent").alias("next"), F.when(~F.col("ignored"), F.nullif(F.trim("name"), F.lit(""))).alias("upper"))
    rows = nodes.where(~F.col("ignored") & F.col("role").isin(*LISTED)).withColumn("called", F.nullif(F.trim("name"), F.lit(""))).withColumn("at", F.col("parent"))
    done, open_ = rows.where("called IS NOT NULL OR at IS NULL"), rows.where("called IS NULL AND at IS NOT NULL")
    parts = [done]
    for _ in range(depth):
        step = open_.join(up, (F.col("screen") == F.col("s")) & (F.col("at") == F.col("up")), "left").withColumn("called", F.col("upper")).withColumn("at", F.col("next")).drop("s", "up", "next", "upper")
        parts.append(step.where("called IS NOT NULL OR at IS NULL"))
        open_ = step.where("called IS NULL AND at IS NOT NULL")
    rows = reduce(DataFrame.unionByName, [*parts, open_])
    side = lambda first: F.array(*[F.get("quad", F.lit(i)) for i in range(first, 8, 2)])
    x, y = F.array_min(side(0)), F.array_min(side(1))
    w, h = F.array_max(side(0)) - x, F.array_max(side(1)) - y
    out = rows.select("screen", "id", "role", F.coalesce("called", F.lit("")).alias("name"), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).alias("box"))
    return out.where("box.w > 0 AND box.h > 0")
