"""Text measures and helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.pii import SPACE


def normalize_ws(text: Column) -> Column:
    """Runs of browser white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ +| +$", "")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def _accuracy(actual: Column, target: Column, if_empty: Column) -> Column:
    return F.when(F.length(target) == 0, if_empty).otherwise(F.greatest(F.lit(0.0), 1 - edit_distance(actual, target) / F.length(target)))


def char_accuracy(actual: Column, target: Column) -> Column:
    """Share of a target text that was read, after white space is normalised; an empty target wants an empty text."""
    a, t = normalize_ws(actual), normalize_ws(target)
    return _accuracy(a, t, F.when(F.length(a) == 0, 1.0).otherwise(0.0))


def char_accuracy_eval(actual: Column, target: Column) -> Column:
    """The same without normalisation; an empty target is always met."""
    return _accuracy(actual, target, F.lit(1.0))


def name_agreement(a: Column, b: Column) -> Column:
    """Names that agree up to case and white space, or hold one another; never empty ones."""
    x, y = F.lower(normalize_ws(a)), F.lower(normalize_ws(b))
    return (F.length(x) > 0) & (F.length(y) > 0) & (F.contains(x, y) | F.contains(y, x))


def windowed(text: Column, value: Column, reach: int = 200) -> Column:
    """``struct<window, start, end>`` around a value's first place, ``reach`` characters each side; null if it isn't there."""
    at = F.instr(text, value) - 1
    low = F.greatest(F.lit(0), at - reach)
    high = F.least(F.length(text), at + F.length(value) + reach)
    return F.when(at >= 0, F.struct(F.substring(text, low + 1, high - low).alias("window"), (at - low).alias("start"), (at - low + F.length(value)).alias("end")))


def terms(task: Column) -> Column:
    """Relevance terms of a task: lower-case runs of ASCII word characters over two long."""
    return F.filter(F.split(F.lower(task), "[^0-9A-Za-z_]+"), lambda t: F.length(t) > 2)


def split_filter(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda t: t != "")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points below 65,536."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    mixed = lambda h, c: (h.bitwiseXOR(c.cast("long")) * 16777619).bitwiseAND(F.lit(4294967295))
    return F.when(F.length(text) == 0, F.lit(2166136261).cast("long")).otherwise(F.aggregate(codes, F.lit(2166136261).cast("long"), mixed))


def lcg(state: Column) -> Column:
    """The next state of the 32-bit linear congruential generator."""
    return (state.cast("long") * 1664525 + 1013904223).bitwiseAND(F.lit(4294967295))


def parse_observe(line: Column) -> Column:
    """Region count and milliseconds of an observation line; 0 where they are missing."""
    number = lambda pattern: F.coalesce(F.regexp_extract(line, pattern, 1).try_cast("int"), F.lit(0))
    return F.struct(number(r"vision read (\d+) region").alias("regions"), number(r"in (\d+) ms").alias("ms"))


def role_alias(role: Column) -> Column:
    """The accessibility tree's name of a role; null stays null."""
    return F.when(role == "text_field", "textbox").otherwise(role)
