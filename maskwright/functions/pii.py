"""Detectors of structured personal data, span resolution, decisions and redaction.

Everything here is a Column expression on the JVM.  Offsets count code points
from 0; ``end`` is exclusive.  A span is
``struct<start:int, end:int, type:string, value:string, confidence:double>``.

Regular expressions follow the browser's rules, not Java's: word boundaries and
digits are ASCII only, white space includes the Unicode spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary between ASCII word characters and all else (Java's own is Unicode-aware).
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
#: White space as browsers define it.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACES}]"

# The structured detectors in order of priority. \b is an ASCII boundary, \s browser white space.
PATTERNS = [
    ("OTP", r"(?i)\b(?:OTP|one[- ]time password)\s*(?:is|:)?\s*\d{4,8}\b"),
    ("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("CARD", r"\b\d(?:[ -]?\d){12,18}\b"),
    ("AADHAAR", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b"),
    ("PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("PHONE", r"(?<!\w)(?:\+?91[ -]?)?[6-9]\d{4}[ -]?\d{5}(?!\d)"),
    ("PHONE", r"(?<!\w)0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}(?!\d)"),
]
#: What a text needs for a detector, by type; far cheaper to look for than the pattern.
NEEDS = {"EMAIL": "@", "CARD": "[0-9](?:[ -]?[0-9]){12}", "OTP": "[0-9]{4}", "AADHAAR": "[0-9]{4}", "PAN": "[0-9]{4}", "PHONE": "[0-9]{3}"}
#: Types whose spans may lose their head to an earlier span and keep the tail.
TRIMMED_TYPES = ("NAME", "ADDRESS")
MASK_AT, REVIEW_AT = 0.6, 0.4
CARD_UNCHECKED = 0.7
SPAN = "struct<start:int,end:int,type:string,value:string,confidence:double>"


def java(pattern: str) -> str:
    """A pattern of :data:`PATTERNS` in Java's syntax."""
    return pattern.replace(r"\b", BOUNDARY).replace(r"\s", SPACE)


def luhn(value: Column) -> Column:
    """The card checksum over the digits of a string; false under 13 digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.coalesce((F.length(digits) >= 13) & F.call_function("luhn_check", digits), F.lit(False))


def worth(text: Column, kind: str) -> Column:
    """A text could hold a match of the type."""
    need = NEEDS.get(kind, "")
    return F.contains(text, F.lit(need)) if need == "@" else text.rlike(need)


#: Items that a fold gathers before it appends them to the others: n items cost n * n / FOLD copies, not n * n.
FOLD = 256


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def folded(items: Column, state: dict[str, Column], step, out: str) -> Column:
    """``aggregate`` whose state, a struct of ``state``'s fields, gathers the array ``out``; in blocks of FOLD items.

    ``step(state, item)`` gives the next state; the array it sees is that of its
    own block only.
    """
    begin = F.struct(*[v.alias(k) for k, v in state.items()])
    with_out = lambda s, array: F.struct(*[(array if k == out else s[k]).alias(k) for k in state])

    def whole(items: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int")))
        block = lambda total, i: F.aggregate(F.slice(items, i * FOLD + 1, FOLD), with_out(total, state[out]), step, lambda s: with_out(s, F.concat(total[out], s[out])))
        return F.aggregate(blocks, begin, block, lambda s: s[out])

    return bound(items, whole)


def matches(text: Column, pattern: str, kind: str, confidence=None) -> Column:
    """All matches of one pattern, left to right; texts without one cost a single search.

    Matches and the gaps before them interleave, so one fold over both gives the
    places.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        sure = F.lit(1.0) if confidence is None else confidence(p["value"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("type"), p["value"].alias("value"), sure.cast("double").alias("confidence"))
        return F.when(p["value"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out")))

    begin = {"at": F.lit(0), "out": none}
    return F.when(F.coalesce(worth(text, kind) & text.rlike(pattern), F.lit(False)), folded(pairs, begin, step, "out")).otherwise(none)


def detector(text: Column, index: int) -> Column:
    """Matches of detector ``index`` of :data:`PATTERNS`."""
    kind, pattern = PATTERNS[index]
    sure = (lambda v: F.when(luhn(v), 1.0).otherwise(CARD_UNCHECKED)) if kind == "CARD" else None
    return matches(text, java(pattern), kind, sure)


def of_type(text: Column, kind: str) -> Column:
    """Matches of all detectors of one type, in reading order."""
    own = [i for i, (k, _) in enumerate(PATTERNS) if k == kind]
    return in_order([(detector(text, i), i) for i in own])


def in_order(families: list[tuple[Column, int]], by_confidence: bool = False) -> Column:
    """Spans by start, then the longer, then (optionally) the surer, then their family's rank and own order."""

    def keyed(spans: Column, rank: int) -> Column:
        doubt = lambda s: -s["confidence"] if by_confidence else F.lit(0.0)
        return F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("shorter"), doubt(s).alias("doubt"), F.lit(rank).alias("rank"), i.alias("at"), s.alias("span")))

    ordered = [keyed(spans, rank) for spans, rank in families]
    return F.transform(F.array_sort(F.concat(*ordered)), lambda x: x["span"])


def structured(text: Column) -> Column:
    """Every structured match in reading order; spans may overlap."""
    return in_order([(detector(text, i), i) for i in range(len(PATTERNS))])


def all_spans(text: Column, unstructured: Column) -> Column:
    """Structured and unstructured matches in reading order, the surer of equal ones first."""
    return in_order([(structured(text), 0), (unstructured, 1)], by_confidence=True)


def without(spans: Column, rejected: Column) -> Column:
    """Spans minus NAME candidates whose ``start:end`` is in ``rejected``; before resolution, so they can't shadow others."""
    key = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    # Bound outside, as what comes from Python can't be computed within a lambda.
    both = F.struct(spans.alias("spans"), F.coalesce(rejected, F.array().cast("array<string>")).alias("no"))
    return bound(both, lambda x: F.filter(x["spans"], lambda s: ~((s["type"] == "NAME") & F.array_contains(x["no"], key(s)))))


def resolved(spans: Column) -> Column:
    """Non-overlapping spans: the earliest start wins, the longest of equal starts.

    A later span that reaches into an earlier one is dropped; NAME and ADDRESS
    keep the part behind it, without leading white space.  ``spans`` should be a
    column of its own, not an expression, or it is computed twice.
    """
    empty = {"cursor": F.lit(-1), "kept": F.array().cast(f"array<{SPAN}>")}

    def step(state: Column, s: Column) -> Column:
        tail = F.substring(s["value"], state["cursor"] - s["start"] + 1, F.length(s["value"]))
        tail = F.regexp_replace(tail, f"^{SPACE}+", "")
        cut = F.struct((s["end"] - F.length(tail)).cast("int").alias("start"), s["end"].alias("end"), s["type"].alias("type"), tail.alias("value"), s["confidence"].alias("confidence"))
        take = lambda x: F.struct(s["end"].alias("cursor"), F.concat(state["kept"], F.array(x)).alias("kept"))
        fuzzy = s["type"].isin(*TRIMMED_TYPES) & (s["end"] > state["cursor"]) & (F.length(tail) > 0)
        return F.when(s["start"] >= state["cursor"], take(s)).when(fuzzy, take(cut)).otherwise(state)

    return F.when(F.size(spans) < 2, spans).otherwise(folded(spans, empty, step, "kept"))


def decision(confidence: Column) -> Column:
    """mask, review or allow."""
    return F.when(confidence >= MASK_AT, "mask").when(confidence >= REVIEW_AT, "review").otherwise("allow")


def token(kind: Column, number: Column) -> Column:
    """``[PII_<TYPE>_<NN>]``, padded to two places and never cut."""
    padded = F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string"))
    return F.concat(F.lit("[PII_"), kind, F.lit("_"), padded, F.lit("]"))


def spliced(text: Column, spans: Column) -> Column:
    """Text with each span's ``put`` in its place; spans (start, end, put) ascend and don't overlap.

    Cutting a piece out of a text costs its whole length, so a text of many spans
    is first cut into stretches of FOLD spans, and these into pieces.
    """

    def joined(text: Column, spans: Column, at: Column, upto: Column | None) -> Column:
        """The stretch from ``at``, where ``text`` begins, to ``upto`` (null: its end)."""

        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(at)
            return F.concat(F.substring(text, begin - at + 1, s["start"] - begin), s["put"])

        last = F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"]).otherwise(at)
        rest = F.substring(text, last - at + 1, F.length(text) if upto is None else upto - last)
        return F.concat(F.concat_ws("", F.transform(spans, piece)), rest)

    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / FOLD).cast("int"))

    def stretch(i: Column) -> Column:
        own = F.slice(spans, i * FOLD + 1, FOLD)
        begin = F.when(i > 0, F.get(spans, i * FOLD)["start"]).otherwise(F.lit(0))
        end = F.coalesce(F.get(spans, (i + 1) * FOLD)["start"], F.length(text))
        return bound(F.substring(text, begin + 1, end - begin), lambda t: joined(t, own, begin, end))

    return F.when(F.size(spans) <= FOLD, joined(text, spans, F.lit(0), None)).otherwise(F.concat_ws("", F.transform(blocks, stretch)))
