"""Benchmark decontamination by pigeonhole edit matching.

A test item of length n with an error budget of ``k = floor(rate * n)`` edits is
split into k + 1 pieces of nearly equal length: an occurrence with at most k
edits leaves one piece untouched.  An Aho-Corasick automaton finds every exact
piece hit in one pass over a text; around each hit's diagonal a window of the
text is verified with Myers' bit-parallel edit distance, where the window's
ends are free.  Texts and items are compared with A-Z lower-cased and each run
of ASCII white space as one space.

A hit first extends to its neighbour pieces: an occurrence with e edits breaks
at most e pieces, so among the k + 1 pieces the untouched ones are found on
diagonals within k of each other; windows of one item that overlap are verified
once.

Scale: test items are a stated query set.  They are dealt by a hash into blocks of
about ``BLOCK_BYTES`` of text, and the driver holds one block at a time, which
goes to the executors as a broadcast.  One block, the usual case, is one narrow
pass without a shuffle.  With more, each pass writes only the rows with a match,
named by id and text hash, and these join the documents in the end.

Defined cases: a null or empty text is clean; null or blank items match
nothing; short items have the budget of their length, so those under 1 / ``rate``
characters are matched exactly; every row is judged by its own text, whatever its
id, and repeated rows and items like others; an empty table or set gives an empty
or all-clean result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import drop_table, filtered, id_and_text, persist

RATE = 0.1
BLOCK_BYTES = 4 << 20


def fold(text: bytes) -> str:
    return b" ".join(text.lower().split()).decode("utf-8", "replace")


def budget(item: str, rate: float) -> int:
    return int(rate * len(item))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(start, text) of k + 1 pieces whose lengths differ by one at most."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item."""

    __slots__ = ("text", "k", "masks", "top", "full")

    def __init__(self, text: str, k: int):
        self.text, self.k = text, k
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)
        self.top, self.full = 1 << (len(text) - 1), (1 << len(text)) - 1

    def best(self, window: str) -> int:
        """Smallest edit distance of the item to any substring of ``window``."""
        pv, mv, score, full, top, masks = self.full, 0, len(self.text), self.full, self.top, self.masks
        low = score
        for c in window:
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < low:
                    low = score
                    if not low:
                        break
            ph <<= 1
            pv = ((mh << 1) | ~(xv | ph)) & full
            mv = ph & xv & full
        return low


class Item:
    """A test item, its pieces and the binary tree over them.

    A node over p pieces has a budget of p - 1 edits: if both children exceed
    theirs, the parent exceeds its own.  So an occurrence within the whole
    budget can be followed from some untouched piece up to the root, and a
    chance hit nearly always ends at its first, short parent.
    """

    __slots__ = ("name", "text", "k", "starts", "parts", "paths")

    def __init__(self, name: object, text: str, k: int):
        self.name, self.text, self.k = name, text, k
        cut = pieces(text, k)
        self.starts, self.parts = [a for a, _ in cut], [x for _, x in cut]
        #: For each piece, its ancestors from the lowest: (start, pattern).
        self.paths: list[list[tuple[int, Pattern]]] = [[] for _ in cut]
        self._node(0, len(cut))

    def _node(self, lo: int, hi: int) -> None:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            self._node(lo, mid)
            self._node(mid, hi)
            node = self.starts[lo], Pattern("".join(self.parts[lo:hi]), hi - lo - 1)
            for i in range(lo, hi):
                self.paths[i].append(node)

    def distance(self, text: str, at: int, piece: int) -> int | None:
        """Of the occurrence that holds ``piece`` untouched at ``at``, if it is within the budget."""
        far = 0
        for start, p in self.paths[piece]:
            a = at - self.starts[piece] + start
            far = p.best(text[max(0, a - p.k) : a + len(p.text) + p.k])
            if far > p.k:
                return None
        return far


class Matcher:
    """Finds items within their error budgets in folded texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        self.items = [Item(i, x, budget(x, rate)) for i, x in items if x]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for j, item in enumerate(self.items):
            for n, piece in enumerate(item.parts):
                where[piece].append((j, n))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def find(self, text: str, first: bool = False) -> list[tuple[object, int]]:
        """(item id, smallest distance) of the items in ``text``, in the items' order; ``first``: any one of them is enough."""
        if not self.any or not text:
            return []
        best: dict[int, int] = {}
        for end, (size, at) in self.automaton.iter(text):
            for j, n in at:
                if best.get(j) == 0:
                    continue
                far = self.items[j].distance(text, end - size + 1, n)
                if far is not None and far < best.get(j, far + 1):
                    best[j] = far
                    if first:
                        return [(self.items[j].name, far)]
        return [(self.items[j].name, best[j]) for j in sorted(best)]


class Blocks:
    """The items in blocks; one at a time is in the driver, and broadcast."""

    def __init__(self, benchmark: DataFrame, rate: float, id_col: str, text_col: str):
        self.rate, self.spark = rate, benchmark.sparkSession
        items = id_and_text(benchmark, id_col, text_col)
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(1, -(-size // BLOCK_BYTES))
        self.items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", F.col("text").cast("string")), F.lit(self.n)))

    def sent(self, block: int) -> Broadcast:
        rows = self.items.where(F.col("block") == block).select("doc_id", "text").toLocalIterator()
        # By item, then text: the order doesn't depend on how the items were read.
        items = sorted(((r["doc_id"], fold(bytes(r["text"]))) for r in rows), key=lambda x: (x[0] is not None, x))
        return self.spark.sparkContext.broadcast([x for x in items if x[1]])


def _judged(items: Broadcast, rate: float, kind: pa.DataType, only: bool):
    """Of (doc_id, text, h): doc_id, h, item_ids, distances; ``only`` those with a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value, rate)
        for batch in batches:
            found = [matcher.find(fold(x.as_py())) for x in batch.column(1)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([[i for i, _ in x] for x in found], pa.list_(kind)), pa.array([[d for _, d in x] for x in found], pa.list_(pa.int32()))], ["doc_id", "h", "item_ids", "distances"])
            yield out.filter(pa.array([bool(x) for x in found])) if only else out

    return run


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, contaminated, item_ids, distances (both in ascending order of the item)."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64(F.col("text").cast("string")))
    kinds = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kinds[0]}, h long, item_ids array<{kinds[1]}>, distances array<int>"
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    blocks = Blocks(benchmark, rate, item_col, item_text)
    if blocks.n == 1:
        out = rows.mapInArrow(_judged(blocks.sent(0), rate, kind, False), schema)
    else:
        hits = None
        for n in range(blocks.n):
            items = blocks.sent(n)
            # Rows with the same id and text have the same matches.
            found = persist(rows.mapInArrow(_judged(items, rate, kind, True), schema), "matches").dropDuplicates(["doc_id", "h"])
            items.unpersist()
            hits = found if hits is None else hits.unionByName(found)
        each = hits.select("doc_id", "h", F.explode(F.arrays_zip("item_ids", "distances")).alias("x"))
        each = each.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("x.item_ids", "x.distances"))).alias("x"))
        each = persist(each.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("x.item_ids").alias("item_ids"), F.col("x.distances").alias("distances")), "matches")
        none = F.array().cast(f"array<{kinds[1]}>"), F.array().cast("array<int>")
        out = rows.select("doc_id", "h").join(each, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select("doc_id", F.coalesce("item_ids", none[0]).alias("item_ids"), F.coalesce("distances", none[1]).alias("distances"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "distances")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those in which an item occurs, all columns as they were; each row by its own text."""
    blocks, before = Blocks(benchmark, rate, item_col, item_text), None
    for n in range(blocks.n):
        items = blocks.sent(n)

        def judge(items=items):
            matcher = Matcher(items.value, rate)
            return lambda texts: [not matcher.find(fold(x), first=True) for x in texts]

        docs = filtered(docs, judge, text_col)
        if n + 1 < blocks.n:
            docs = persist(docs, "clean")
            items.unpersist()
            if before is not None:
                drop_table(before)
            before = docs
    return docs
