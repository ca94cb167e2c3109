"""Language identification by rank-order n-gram profiles.

A profile is the ``PROFILE`` most frequent character n-grams (1 to 3 characters;
words are lower-cased and stand between single blanks) in order of their
frequency.  A document's distance to a language is the sum, over the document's
profile, of how far each n-gram is out of place in the language's profile; an
n-gram that isn't there counts as ``PROFILE`` places.  The nearest language
wins; ties go to the smaller name.

N-grams are numbers: a character is its code point, so n-grams of up to three
fit 63 bits.  Counting is by sorted arrays, never by strings.

Scale: training counts the n-grams of every learnt document in one narrow pass,
per task and language, and adds them up by (language, n-gram).  Profiles reach
the driver and the executors in blocks of ``LANGUAGES`` languages, each at most
LANGUAGES x PROFILE numbers; a text passes one block after another and keeps the
nearest so far.  Prediction is one more narrow pass over whole texts.

Defined cases: ``und`` with score 0 for null and empty texts and those without a
letter, and if no language was learnt; rows whose language is null aren't
learnt from; equal counts are ordered by the n-gram's number; repeated rows are
judged alike; null ids count as empty text in the fold; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.llm.common import fold, persist

PROFILE = 400
LANGUAGES = 5000
UNKNOWN = "und"
#: Characters of a text that are counted at once.
SLICE = 1 << 20
#: Distinct n-grams of a language that a task gathers before it passes them on.
HELD = 1 << 20


def _letters() -> np.ndarray:
    """For each code point its lower case if that is one letter; 32 for all else."""
    out = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


LETTERS = _letters()


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts; none if it has no letter."""
    keys, counts = [], []
    tail = np.array([32], np.int64)
    for at in range(0, len(text), SLICE):
        code = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        last = at + SLICE >= len(text)
        c = np.concatenate([tail, LETTERS[code], [32] if last else []]).astype(np.int64)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]  # single blanks
        if len(c) < 2:
            tail = c
            continue
        # The last two characters open the next slice, so their n-grams count there.
        new = len(c) if last else len(c) - 2
        one = c[:new][c[:new] != 32]
        two = (c[:-1] << 21 | c[1:])[:new]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:new]
        three = three[c[1:-1][: len(three)] != 32]
        k, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
        keys.append(k)
        counts.append(n)
        tail = c[max(new, 0) :]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys in order; ``keys`` ascend, so a stable sort settles ties."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        k, where = np.unique(np.concatenate([x for x, _ in held[lang]]), return_inverse=True)
        n = np.bincount(where, np.concatenate([x for _, x in held[lang]])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            k, n = ngrams(text.as_py())
            if not len(k):
                continue
            held.setdefault(lang, []).append((k, n))
            sizes[lang] = sizes.get(lang, 0) + len(k)
            if sizes[lang] > HELD:
                got = out(lang)
                held[lang], sizes[lang] = [(np.asarray(got.column(1)), np.asarray(got.column(2)))], got.num_rows
                if got.num_rows > HELD // 2:
                    yield got
                    del held[lang], sizes[lang]
    for lang in held:
        yield out(lang)


def profiles(docs: DataFrame, use: Column | None = None, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, grams): the n-gram profile of every language of ``docs`` in its order, over whole texts of rows for which ``use`` holds."""
    rows = docs if use is None else docs.where(use)
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    return persist(ranked.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "gram"))), lambda x: x["gram"]).alias("grams")), "profiles")


class Nearest:
    """For each n-gram of some profiles the languages that have it, and its place there."""

    def __init__(self, known: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(known), size
        grams = np.concatenate([*(known[x] for x in self.names), np.empty(0, np.int64)])
        order = np.argsort(grams, kind="stable")
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.first = np.append(self.first, len(grams))
        self.lang = np.repeat(np.arange(len(self.names)), [len(known[x]) for x in self.names])[order]
        self.place = np.concatenate([*(np.arange(len(known[x])) for x in self.names), np.empty(0, np.int64)])[order]

    def distances(self, mine: np.ndarray) -> np.ndarray:
        """Of each language to a document's profile: ``size`` places for an n-gram it lacks, else how far it is out of place."""
        at = np.searchsorted(self.grams, mine)
        rank = np.flatnonzero((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == mine)) if len(self.grams) else at[:0]
        at = at[rank]
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        nearer = self.size - np.abs(self.place[entry] - np.repeat(rank, n))
        return self.size * len(mine) - np.bincount(self.lang[entry], nearer, len(self.names)).astype(np.int64)

    def __call__(self, mine: np.ndarray) -> tuple[int, str]:
        """Distance and name of the nearest language, of equal ones the smaller name."""
        far = self.distances(mine)
        best = int(np.argmin(far))
        return int(far[best]), self.names[best]


def _predicted(sent: Broadcast, size: int, first: bool, last: bool):
    """Adds a block of profiles to what is known of (doc_id, far, lang_pred, worst, text); the last drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(sent.value, size)
        for batch in batches:
            rows = []
            before = [(None, UNKNOWN, 0)] * len(batch) if first else list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
            for x, old in zip(batch.column(batch.num_columns - 1), before, strict=True):
                k, n = ngrams(x.as_py() or "")
                if not len(k) or not nearest.names:
                    rows.append(old)
                    continue
                mine = top(k, n, size)
                far, name = nearest(mine)
                rows.append((far, name, size * len(mine)) if old[0] is None or (far, name) < old[:2] else old)
            far, names, worst = ([r[i] for r in rows] for i in range(3))
            columns = [batch.column(0), pa.array(far, pa.int64()), pa.array(names, pa.string()), pa.array(worst, pa.int64()), batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns[: 5 - last], ["doc_id", "far", "lang_pred", "worst", "text"][: 5 - last])

    return run


def predict(docs: DataFrame, known: DataFrame, size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, lang_pred, score (1: the profiles are the same; 0: nothing in common)."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(out.dtypes)["doc_id"]
    blocks = max(1, -(-known.count() // LANGUAGES))
    for n in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == n).collect()
        sent = docs.sparkSession.sparkContext.broadcast({r["lang"]: np.array(r["grams"], np.int64) for r in rows})
        out = out.mapInArrow(_predicted(sent, size, n == 0, n + 1 == blocks), f"doc_id {kind}, far long, lang_pred string, worst long" + ", text string" * (n + 1 < blocks))
    return out.select("doc_id", "lang_pred", F.when(F.col("far").isNull(), 0.0).otherwise(1 - F.col("far") / F.col("worst")).alias("score"))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from ids whose crc32 mod 5 isn't 0."""
    known = profiles(docs, fold("doc_id", 5) != 0)
    return predict(docs, known).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
