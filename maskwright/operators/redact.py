"""Redaction: spans become tokens, numbered by first appearance within a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.functions import pii
from maskwright.sources.scratch import persist


def redacted(text: Column, spans: Column) -> Column:
    """One text as a scope of its own: ``struct<text, matches, requires_review, tokens>``.

    ``spans`` are resolved.  Needs no shuffle: a token's number is the place of
    its value among the distinct values of its type.
    """
    allowed = lambda s: pii.decision(s["confidence"]) == "allow"
    put = F.filter(spans, lambda s: ~allowed(s))

    def few(s: Column) -> Column:
        values = F.array_distinct(F.transform(F.filter(put, lambda x: x["type"] == s["type"]), lambda x: x["value"]))
        return F.array_position(values, s["value"])

    numbers = F.when(F.size(put) <= FEW, F.transform(spans, lambda s: F.when(allowed(s), 0).otherwise(few(s)))).otherwise(_numbers(spans))
    piece = lambda s, n: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(allowed(s), s["value"]).otherwise(pii.token(s["type"], n)).alias("put"))
    pieces = F.zip_with(spans, numbers, piece)
    return F.struct(
        pii.bound(pieces, lambda p: pii.spliced(text, p)).alias("text"),
        F.transform(spans, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence"))).alias("matches"),
        F.exists(spans, lambda s: pii.decision(s["confidence"]) == "review").alias("requires_review"),
        F.size(F.array_distinct(F.transform(put, lambda s: F.concat(s["type"], F.lit(":"), s["value"])))).alias("tokens"),
    )


#: Spans of a text up to which numbers are found by looking through the others.
FEW = 32


def _numbers(spans: Column) -> Column:
    """Each span's token number (0: it is allowed), by sorting: equal values get together, their first one counts them."""
    row = "struct<type:string,value:string,at:int>"
    placed = F.transform(spans, lambda s, i: F.struct(s["type"].alias("type"), s["value"].alias("value"), i.alias("at"), (pii.decision(s["confidence"]) != "allow").alias("put")))
    rows = F.array_sort(F.transform(F.filter(placed, lambda x: x["put"]), lambda x: F.struct(x["type"], x["value"], x["at"]))).cast(f"array<{row}>")
    first = {"type": F.lit(""), "value": F.lit(""), "first": F.lit(-1), "out": F.array().cast("array<struct<type:string,first:int,at:int>>")}

    def grouped(state: Column, x: Column) -> Column:
        same = (state["type"] == x["type"]) & (state["value"] == x["value"]) & (state["first"] >= 0)
        head = F.when(same, state["first"]).otherwise(x["at"])
        return F.struct(x["type"].alias("type"), x["value"].alias("value"), head.alias("first"), F.concat(state["out"], F.array(F.struct(x["type"].alias("type"), head.alias("first"), x["at"].alias("at")))).alias("out"))

    count = {"type": F.lit(""), "n": F.lit(0), "out": F.array().cast("array<struct<at:int,n:int>>")}

    def counted(state: Column, x: Column) -> Column:
        before = F.when(state["type"] == x["type"], state["n"]).otherwise(0)
        n = before + (x["first"] == x["at"]).cast("int")
        return F.struct(x["type"].alias("type"), n.alias("n"), F.concat(state["out"], F.array(F.struct(x["at"].alias("at"), n.alias("n")))).alias("out"))

    numbered = pii.folded(F.array_sort(pii.folded(rows, first, grouped, "out")), count, counted, "out")
    allowed = F.transform(F.filter(placed, lambda x: ~x["put"]), lambda x: F.struct(x["at"].alias("at"), F.lit(0).alias("n")))
    return F.transform(F.array_sort(F.concat(numbered, allowed)), lambda x: x["n"])


def span_rows(rows: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row a span, with its place ``at`` in its text."""
    return rows.select(*keys, F.posexplode_outer(spans).alias("at", "s")).where("s IS NOT NULL").select(*keys, "at", "s.*")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their row number within ``keys`` by ``order``; a key with very many rows is no single task's work.

    Rows are sorted by ranges and written; a row's number is its place in its
    range, after the key's rows in the ranges before.
    """
    part, before = "__part", "__before"
    placed = persist(rows.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranked")
    counts = placed.groupBy(part, *keys).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = persist(counts.withColumn(before, F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n"), "ranked")
    here = F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order))
    return placed.withColumn(name, here).join(counts, [part, *keys]).withColumn(name, (F.col(name) + F.col(before)).cast("int")).drop(part, before)


def token_map(spans: DataFrame, scope: str = "scope_id", order: str = "ord") -> DataFrame:
    """(scope, type, value, number, token): private, never to be exported.

    ``spans`` are resolved rows of :func:`span_rows`; equal values of a type
    share a token.  Values are reduced to one row each before they are ranked.
    The map is written, so that joins with it can split a frequent value.
    """
    masked = spans.where(pii.decision(F.col("confidence")) != "allow")
    first = masked.groupBy(scope, "type", "value").agg(F.min(F.struct(order, "start")).alias("first"))
    numbered = ranked(first.select(scope, "type", "value", F.col(f"first.{order}").alias("__ord"), F.col("first.start").alias("__start")), [scope, "type"], ["__ord", "__start"], "number")
    return persist(numbered.select(scope, "type", "value", "number", pii.token(F.col("type"), F.col("number")).alias("token")), "tokens")


def redact_scopes(rows: DataFrame, scope: str = "scope_id", order: str = "ord", text: str = "text", spans: str = "spans") -> DataFrame:
    """``rows`` (without their spans) with redacted text, pii_type, n_matches and requires_review; tokens are shared by a scope."""
    found = span_rows(rows, [scope, order], spans)
    tokens = token_map(found, scope, order).select(scope, "type", "value", "token")
    put = F.coalesce("token", "value")
    pieces = found.join(tokens, [scope, "type", "value"], "left").groupBy(scope, order).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", put.alias("put")))).alias("pieces"),
        F.min_by("type", "at").alias("pii_type"),
        F.max(pii.decision(F.col("confidence")) == "review").alias("requires_review"),
    )
    none = F.array().cast("array<struct<start:int,end:int,put:string>>")
    out = rows.drop(spans).join(pieces, [scope, order], "left")
    n = F.coalesce(F.size("pieces"), F.lit(0))
    return out.withColumn(text, pii.spliced(F.coalesce(F.col(text), F.lit("")), F.coalesce("pieces", none))).withColumn("n_matches", F.when(F.col("pieces").isNull(), 0).otherwise(n)).withColumn("requires_review", F.coalesce("requires_review", F.lit(False))).drop("pieces")


def detokenized(rows: DataFrame, tokens: DataFrame, scope: str = "scope_id", token: str = "token") -> DataFrame:
    """``rows`` with each token's value from the private map; null for unknown tokens."""
    return rows.join(tokens.select(scope, token, "value"), [scope, token], "left")


def has_structured(text: Column) -> Column:
    """A text that holds structured personal data (the audit log's constraint)."""
    text = F.coalesce(text, F.lit(""))
    found = F.lit(False)
    for kind, pattern in pii.PATTERNS:
        found = found | (pii.worth(text, kind) & text.rlike(pii.java(pattern)))
    return found


def pii_free(text: Column) -> Column:
    """The text itself; raises where it holds structured personal data."""
    return F.when(has_structured(text), F.raise_error(F.lit("the audit detail holds personal data")).cast("string")).otherwise(text)
