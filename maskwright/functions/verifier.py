"""Name verification: WordPiece tokens, person probabilities, and rejection of candidates.

The model is a function that the caller passes; what it can't judge stays
masked.  A candidate is rejected only if its score is under ``CONFIRM``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import names, pii

CONFIRM, REACH, MAX_TOKENS, MAX_WORD = 0.02, 200, 512, 100
GIVEN = frozenset(names.GIVEN_NAMES)
#: Labels of the token classifier that stand for a person.
PERSON = (1, 2)


def _cjk(c: str) -> bool:
    n = ord(c)
    return 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF or 0xF900 <= n <= 0xFAFF or 0x20000 <= n <= 0x2CEAF


def _stands_alone(c: str) -> bool:
    n = ord(c)
    return _cjk(c) or 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126 or unicodedata.category(c)[0] == "P"


class WordPiece:
    """Lower-cased, accent-free greedy longest-match tokens with their places."""

    def __init__(self, vocabulary: list[str], unknown: str = "[UNK]"):
        self.ids, self.unknown = {w: i for i, w in enumerate(vocabulary)}, unknown

    def words(self, text: str) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        start = None
        for i, c in enumerate(text + " "):
            breaks = c.isspace() or _stands_alone(c)
            if breaks and start is not None:
                out.append((text[start:i], start, i))
                start = None
            if breaks and not c.isspace():
                out.append((c, i, i + 1))
            elif not breaks and start is None:
                start = i
        plain = lambda w: "".join(x for x in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(x) != "Mn")
        return [(plain(w), a, b) for w, a, b in out]

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """(piece, start, end of its word), between [CLS] and [SEP], at most MAX_TOKENS."""
        out = [("[CLS]", 0, 0)]
        for word, a, b in self.words(text):
            out += [(p, a, b) for p in self.pieces(word)]
        return [*out[: MAX_TOKENS - 1], ("[SEP]", 0, 0)]

    def pieces(self, word: str) -> list[str]:
        if len(word) > MAX_WORD:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.ids), None)
            if end is None:
                return [self.unknown]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out


def person_probability(logits: np.ndarray) -> np.ndarray:
    """The larger of the person labels' softmax shares, for each token."""
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return (e / e.sum(-1, keepdims=True))[..., list(PERSON)].max(-1)


def span_score(tokens: list[tuple[str, int, int]], probabilities: np.ndarray, start: int, end: int) -> float:
    """The best probability of the tokens that a span overlaps."""
    return max((float(p) for (_, a, b), p in zip(tokens, probabilities, strict=True) if b > a and a < end and b > start), default=0.0)


def word_pieces(text: Column, vocabulary: list[str]) -> Column:
    cut = WordPiece(vocabulary)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[p for p, _, _ in cut(t)] if t is not None else None for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)


def rejected(text: Column, candidates: Column, score: Callable[[str, str], float]) -> Column:
    """``start:end`` of NAME candidates that the model, asked within REACH characters, doesn't confirm; none if it fails."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            asked = [s for s in found or [] if s["type"] == "NAME"]
            try:
                out.append([f"{s['start']}:{s['end']}" for s in asked if score(t[max(0, s["start"] - REACH) : s["end"] + REACH], s["value"]) < CONFIRM])
            except Exception:  # a verifier that fails rejects nothing: everything stays masked
                out.append([])
        return pa.array(out, pa.list_(pa.string()))

    return run(text, candidates)


def verified(rows: DataFrame, score: Callable[[str, str], float], text: str = "text") -> DataFrame:
    """``rows`` with a row for each resolved span; rejected names go before resolution."""
    # The model is asked about the rules' own output: what it is passed must not come out of nested lambdas.
    fuzzy = names.unstructured(F.col(text))
    asked = rows.withColumn("__found", pii.all_spans(F.col(text), fuzzy)).withColumn("__no", rejected(F.col(text), fuzzy, score))
    spans = asked.withColumn("__kept", pii.without(F.col("__found"), F.col("__no"))).withColumn("__s", F.explode_outer(pii.resolved(F.col("__kept")))).where("__s IS NOT NULL")
    return spans.select(*rows.columns, F.col("__s.type").alias("type"), F.col("__s.value").alias("value"), F.col("__s.start").alias("start"), F.col("__s.end").alias("end"), F.col("__s.confidence").alias("confidence"))


def person_share(logits: Column) -> Column:
    """The larger of the person labels' softmax shares, of one token's logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.greatest(*[F.get(e, F.lit(i)) for i in PERSON]) / F.aggregate(e, F.lit(0.0), lambda s, x: s + x)


def best_share(tokens: Column, start: Column, end: Column) -> Column:
    """The best ``share`` among tokens (start, end, share) that a span overlaps; 0 if none does."""
    hit = F.filter(tokens, lambda t: (t["end"] > t["start"]) & (t["start"] < end) & (t["end"] > start))
    return F.coalesce(F.array_max(F.transform(hit, lambda t: t["share"])), F.lit(0.0))
