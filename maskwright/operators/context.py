"""From perceived elements to the minimum context: fuse, filter, rank, project, render."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.functions.geometry import iou
from maskwright.functions.text import terms

# Roles that are always relevant, roles that can be clicked, attributes of credential fields.
ACTIONABLE = ("button", "link", "text_field", "checkbox", "radio", "combobox", "menuitem")
CLICKABLE = ("button", "link", "menuitem")
CREDENTIAL_TYPES = ("password", "hidden")
CREDENTIAL_AUTOCOMPLETE = ("current-password", "new-password", "one-time-code", "cc-number", "cc-csc", "cc-exp", "cc-exp-month", "cc-exp-year")
DUPLICATE_IOU = 0.7


def relevant(role: Column, text: Column, task: Column) -> Column:
    """Actionable, or some term of the task occurs in the text."""
    return role.isin(*ACTIONABLE) | F.exists(terms(task), lambda t: F.contains(F.lower(text), t))


def perceivable(hidden: Column, aria_hidden: Column, w: Column, h: Column, display: Column, visibility: Column) -> Column:
    return ~F.coalesce(hidden, F.lit(False)) & (F.coalesce(aria_hidden, F.lit("")) != "true") & (w > 0) & (h > 0) & (F.coalesce(display, F.lit("")) != "none") & (F.coalesce(visibility, F.lit("")) != "hidden")


def visible_region(hidden: Column, aria_hidden: Column, display: Column, visibility: Column, opacity: Column) -> Column:
    return ~F.coalesce(hidden, F.lit(False)) & (F.coalesce(aria_hidden, F.lit("")) != "true") & (F.coalesce(display, F.lit("")) != "none") & (F.coalesce(visibility, F.lit("")) != "hidden") & (F.coalesce(opacity, F.lit("")) != "0")


def credential(tag: Column, kind: Column, autocomplete: Column, marked: Column) -> Column:
    """A field whose value must never be read."""
    return F.coalesce(F.trim(F.lower(autocomplete)).isin(*CREDENTIAL_AUTOCOMPLETE), F.lit(False)) | ((tag == "input") & F.coalesce(F.lower(kind).isin(*CREDENTIAL_TYPES), F.lit(False))) | (F.coalesce(marked, F.lit("")) == "true")


#: Recognised words under this confidence, of 100, are left out.
READ_AT = 50


def read_words(words: DataFrame, text: str = "text", confidence: str = "confidence") -> DataFrame:
    """Recognised words that are sure enough and not blank, with ``confidence`` from 0 to 1."""
    sure = words.where((F.col(confidence) >= READ_AT) & (F.trim(text) != ""))
    return sure.withColumn("confidence", F.col(confidence) / 100)


def role_of(tag: Column, role: Column, kind: Column) -> Column:
    kind = F.lower(kind)
    implicit = F.when(tag == "input", F.when(kind.isin("checkbox", "radio"), kind).otherwise("text_field")).when(tag == "a", "link").when(tag == "button", "button").when(tag == "select", "combobox").when(tag == "textarea", "text_field").otherwise("interactive")
    return F.coalesce(F.nullif(role, F.lit("")), implicit)


def text_of(is_field: Column, aria_label: Column, label: Column, placeholder: Column, name: Column, content: Column) -> Column:
    """What an element is called: never what a field holds."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(some(aria_label), F.when(is_field, F.coalesce(some(label), F.nullif(placeholder, F.lit("")), F.nullif(name, F.lit("")), F.lit(""))).otherwise(F.coalesce(some(content), F.lit(""))))


def marked(elements: DataFrame, task: Column, screen: str = "screen_id", order: str = "ord") -> DataFrame:
    """Elements that may be sent, with contiguous marks ``M1..Mn`` in reading order."""
    kept = elements.where(~F.coalesce(F.col("sensitive"), F.lit(False))).where(relevant(F.col("role"), F.col("text"), task))
    n = F.row_number().over(Window.partitionBy(screen).orderBy(order))
    return kept.withColumn("mark", n).withColumn("mark_id", F.concat(F.lit("M"), F.col("mark").cast("string")))


def context(elements: DataFrame, task: Column, screen: str = "screen_id", order: str = "ord") -> DataFrame:
    """One row a screen with an element left: the elements of its payload (mark_id, role, text, bbox only)."""
    rows = marked(elements, task, screen, order)
    element = F.struct("mark_id", "role", "text", F.array("bbox.x", "bbox.y", "bbox.w", "bbox.h").alias("bbox"))
    return rows.groupBy(screen).agg(F.transform(F.array_sort(F.collect_list(F.struct("mark", element.alias("e")))), lambda x: x["e"]).alias("elements"))


def fused(dom: DataFrame, vision: DataFrame, at: float = DUPLICATE_IOU, screen: str = "screen_id") -> DataFrame:
    """All DOM elements and the vision elements that none of them overlaps at ``at`` or more."""
    d = dom.select(F.col(screen).alias("__s"), F.col("bbox").alias("__b"))
    return dom.unionByName(unmatched(vision, d, at, screen))


def unmatched(rows: DataFrame, others: DataFrame, at: float, screen: str = "screen_id") -> DataFrame:
    """``rows`` without those that a box of ``others`` (__s, __b) overlaps at ``at`` or more."""
    return rows.join(others, (F.col(screen) == F.col("__s")) & (iou(F.col("bbox"), F.col("__b")) >= at), "left_anti")


#: Side of the grid cells in which boxes look for each other.
CELL = 128


def _celled(rows: DataFrame) -> DataFrame:
    """A row for each cell that a row's ``box`` covers."""
    box = F.col("box")
    cells = lambda at, size: F.sequence(F.floor(box[at] / CELL), F.floor((box[at] + F.greatest(box[size], F.lit(0))) / CELL))
    return rows.withColumn("cx", F.explode(cells("x", "w"))).withColumn("cy", F.explode(cells("y", "h")))


def overlaps(a: DataFrame, b: DataFrame, at: float, screen: str = "screen_id") -> DataFrame:
    """Pairs of one screen at ``at`` (above 0) or more: screen, want (of a), got (of b), iou; a and b have ord and bbox.

    Boxes meet in the cells of a grid, so those far apart make no pairs; a pair
    counts in the cell of its intersection's corner only.
    """
    x = _celled(a.select(screen, F.col("ord").alias("want"), F.col("bbox").alias("box"))).withColumnRenamed("box", "x")
    y = _celled(b.select(screen, F.col("ord").alias("got"), F.col("bbox").alias("box"))).withColumnRenamed("box", "y")
    corner = lambda at: F.floor(F.greatest(F.col("x")[at], F.col("y")[at]) / CELL)
    met = x.join(y, [screen, "cx", "cy"]).where((F.col("cx") == corner("x")) & (F.col("cy") == corner("y")))
    return met.withColumn("iou", iou(F.col("x"), F.col("y"))).where(F.col("iou") >= at).select(screen, "want", "got", "iou")


def matched(pairs: DataFrame, screen: str = "screen_id") -> DataFrame:
    """Greedy one-to-one matches of :func:`overlaps`.

    Wanted items in ascending order each take the best item still free; of equal
    overlaps the smaller ``got``.  One screen's few pairs are one group.
    """

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("want", "ascending"), ("iou", "descending"), ("got", "ascending")])
        wanted, taken, keep = set(), set(), []
        for i, (w, g) in enumerate(zip(t["want"].to_pylist(), t["got"].to_pylist(), strict=True)):
            if w not in wanted and g not in taken:
                wanted.add(w)
                taken.add(g)
                keep.append(i)
        return t.take(keep)

    return pairs.groupBy(screen).applyInArrow(run, pairs.schema)


def best_of(pairs: DataFrame, screen: str = "screen_id") -> DataFrame:
    """For each wanted item the best overlap, of equal ones the smaller; not one-to-one."""
    return pairs.groupBy(screen, "want").agg(F.min(F.struct((-F.col("iou")).alias("k"), "got", "iou")).alias("m")).select(screen, "want", "m.got", "m.iou")


def deterministic(contexts: DataFrame, task: Column, history: Column) -> DataFrame:
    """The keyword reasoner: ``contexts`` (elements) with action, target_id, confidence.

    Done once a step of the history was executed; else the first clickable
    element that shares a word with the task; else none.  Words are split at
    white space here, unlike the terms of :func:`relevant`.
    """
    words = lambda t: F.split(F.lower(t), r"\s+")
    wanted = F.filter(words(task), lambda t: F.length(t) > 2)
    hit = F.filter("elements", lambda e: e["role"].isin(*CLICKABLE) & ((F.size(wanted) == 0) | F.arrays_overlap(wanted, words(e["text"]))))
    done = F.exists(F.coalesce(history, F.array().cast("array<string>")), lambda h: h.startswith("executed"))
    found = F.size(hit) > 0
    return contexts.select(
        "*",
        F.when(done, "done").when(found, "click").otherwise("none").alias("action"),
        F.when(~done & found, F.get(hit, F.lit(0))["mark_id"]).alias("target_id"),
        F.when(done, 0.6).when(found, 0.8).otherwise(0.0).alias("confidence"),
    )


def first_available(providers: list[tuple[Column, Column]]) -> Column:
    """The answer of the first provider (available, answer) that is available, whatever it answers."""
    out = None
    for available, answer in providers:
        out = F.when(available, answer) if out is None else out.when(available, answer)
    return out


def first_valid(attempts: DataFrame, key: str, order: str = "attempt", problem: str = "problem") -> DataFrame:
    """Each key's first attempt without a semantic problem; keys without one get action none."""
    columns = [c for c in attempts.columns if c not in (key, problem)]
    best = attempts.groupBy(key).agg(F.min_by(F.struct(*columns), F.when(F.col(problem).isNull(), F.col(order))).alias("b"))
    return best.select(key, F.coalesce("b.action", F.lit("none")).alias("action"), *[F.col(f"b.{c}").alias(c) for c in columns if c != "action"])


def _quoted(text: Column) -> Column:
    """A string literal: single quotes unless the text has some and no double ones."""
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    plain = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def prompt(task: Column, step: Column, limit: Column, page_ident: Column, history: Column, elements: Column) -> Column:
    """The context as lines of text for a model."""
    strings = lambda *x: F.array(*x).cast("array<string>")
    none = strings()
    past = F.transform(history, lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h["action"], F.coalesce(F.concat(F.lit(" on a "), F.nullif(h["target_role"], F.lit(""))), F.lit("")), F.lit(" -> "), h["outcome"], F.coalesce(F.concat(F.lit(" [page: "), F.nullif(h["page_ident"], F.lit("")), F.lit("]")), F.lit(""))))
    seen = F.transform(elements, lambda e: F.concat(F.lit("- "), e["mark_id"], F.lit(" ["), e["role"], F.lit("] "), _quoted(F.trim(e["text"])), F.lit(" at ("), F.array_join(F.transform(e["bbox"], lambda b: b.cast("string")), ", "), F.lit(")")))
    return F.array_join(
        F.concat(
            strings(F.concat(F.lit("Task: "), task)),
            F.when(step.isNull(), none).otherwise(strings(F.concat(F.lit("Step "), step.cast("string"), F.lit(" of at most "), limit.cast("string"), F.lit(".")))),
            F.when(F.coalesce(page_ident, F.lit("")) == "", none).otherwise(strings(F.concat(F.lit("Current page title: "), _quoted(page_ident)))),
            F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, none).otherwise(F.concat(strings(F.lit(""), F.lit("Previous steps:")), past)),
            strings(F.lit(""), F.lit("Elements:")),
            F.when(F.size(elements) == 0, strings(F.lit("- (none visible)"))).otherwise(seen),
            strings(F.lit(""), F.lit("Answer with the JSON action.")),
        ),
        "\n",
    )
