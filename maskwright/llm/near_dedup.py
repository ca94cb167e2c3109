"""Near-duplicates by bottom-k sketches of one hash function.

1. Every text becomes the set of its word shingles' 64-bit hashes; the ``SKETCH``
   smallest values are its sketch.  Documents with equal sets form a class and
   only the class's smallest id goes on, so copies never make pairs.
2. Inverted lists: each retained value is counted over all classes.  A class is
   posted under the rarest of its retained values only - so many that two sets
   of the wanted similarity must meet in one of them (:func:`posted`).  Values
   that few documents hold come first, so frequent phrases get no list unless a
   text has nothing else.
3. In each list, every class meets ``PIVOTS`` classes picked by a global hash
   order.  Pairs are filtered by the similarity that the sketch of their union
   estimates, then verified on full sets; the links give components.
4. Lists that now lie in one component are finished: further pairs in them can't
   change a result.  In the others, all pairs that cross components are
   examined; long lists in blocks of ``BLOCK`` by ``BLOCK`` within tasks, which
   compare full sets and pass on a spanning forest of their links.  A block holds
   classes of like size (``BAND``), so it meets only its own band and the next.
   These links join the first ones.

No partner or candidate is capped: what a pivot doesn't settle, step 4 does.
The bounds on sketches are so low that a pair at the very threshold fails one
with a chance of 1e-7; apart from that the result equals that of comparing all
pairs.

Scale: texts are read twice (the second time only texts in surviving pairs keep
their sets); values are counted by :mod:`maskwright.llm.exchange`, so a frequent
one costs an entry a block of classes; the largest shuffle is one row a posted
value.  Tables that a hot key is joined with are written first, so that adaptive
execution can split its partition.  Memory is that of one text, or of two blocks
of sets.

Defined cases: null, empty and all-blank texts have an empty set, link with
nothing and are kept; a text of fewer words than a shingle is one shingle of
all its words; rows that repeat an id each get a row, by their own text, and
classes whose smallest id is the same are one node; a null id gets a null
component, unless a class with its set has an id, and is kept; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm import exchange
from maskwright.llm.common import BITS, bitmap, drop_table, id_and_text, mark, once, persist, without
from maskwright.llm.components import components

SKETCH = 128
#: Sketch sizes by which pairs are filtered: a short one first, as it discards chance meetings for little.
FILTERS = (16, SKETCH)
#: Chance that a linked pair fails a bound.
TAIL = 1e-7
PIVOTS = 4
#: Classes whose values are counted and listed together.
LISTED = 4096
#: Lists up to this size are joined with themselves; longer ones are examined in blocks.
SHORT = 48
BLOCK = 1024
#: Sizes of one band differ by less than this factor at most; similar sets are in one band or in neighbours.
BAND = 1.25
#: Rows of a block that are compared with the other block at once.
STRIPE = 256
#: Distinct words whose hashes one task remembers.
WORDS = 1_000_000
#: Odd, so multiplying by it is one to one.
MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY_HASH = b"\0" * 16


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        if len(known) > WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        n = len(h) - width + 1
        x = np.full(n, width, np.uint64)
        for i in range(width):
            x = (x ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return np.unique(x.view(np.int64))


def overlap_needed(size: int, percent: int, k: int = SKETCH) -> int:
    """Values that the sketches of a set of ``size`` and any set as similar share at least.

    Sets within the sketch are whole, so the bound is exact; else a share of the
    union's sketch, a binomial count, with a tail under ``TAIL``.
    """
    if size * 100 <= k * percent:  # any partner is whole too
        return math.ceil(size * percent / 100)
    if size < k:
        return min(math.ceil(size * percent / 100), k - math.floor((100 / percent - 1) * size))
    p, tail = percent / 100, 0.0
    for t in range(k + 1):
        tail += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > TAIL:
            return t
    return k


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in batches:
            sizes, prints, sketches = [], [], []
            for x in batch.column(1):
                s = cut(x.as_py())
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else EMPTY_HASH)
                sketches.append(s[:SKETCH])
            at = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
            values = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(values, pa.int64()))], ["doc_id", "n_shingles", "print", "sketch"])

    return run


def _sets(width: int, short: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(s) if short else s.tobytes() for s in (cut(x.as_py()) for x in batch.column(1))], pa.binary())], ["doc_id", "hashes"])

    return run


def _packed(hashes: np.ndarray) -> bytes:
    """48 bits a hash: within one pair of sets a chance meeting is rarer than 1e-8."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.int64)


def _measured(percent: int):
    """Exact overlap of pairs' full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = _unpacked(x.as_py()), _unpacked(y.as_py())
                n = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                both.append(n)
                linked.append(100 * n >= percent * (len(p) + len(q) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"])

    return run


def _estimated(percent: int, k: int) -> Column:
    """The union's sketch of ``k`` holds enough common values."""
    whole = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(whole, F.array_intersect("sa", "sb")))
    return common >= F.when(F.size(whole) < k, F.ceil(F.size(whole) * percent / 100)).otherwise(overlap_needed(k, percent, k))


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _filtered(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches allow the similarity."""
    for k in FILTERS:
        one = sigs.select(F.col("doc_id").alias("a"), F.slice("sketch", 1, k).alias("sa"))
        two = sigs.select(F.col("doc_id").alias("b"), F.slice("sketch", 1, k).alias("sb"))
        pairs = pairs.join(one, "a").join(two, "b").where(_estimated(percent, k)).select("a", "b")
    return pairs


def _some(rows: DataFrame, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (id, ``columns``) whose id may be in ``ids``, without a shuffle: by a bitmap of hashed ids.

    Its size is fixed; with more ids than it can tell apart it lets more rows
    pass, and the join that follows drops them.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))

    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(bitmap(ids.select(slot))).tobytes())

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            last = batch.num_columns - 1
            found = batch.filter(pa.array(bits[np.asarray(batch.column(last))]))
            yield pa.RecordBatch.from_arrays(found.columns[:last], batch.schema.names[:last])

    out = rows.select("doc_id", *(columns or ["text"]))
    return rows.select(*out.columns, slot.alias("slot")).where("doc_id IS NOT NULL").mapInArrow(passed, out.schema)


def _measure(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, both, linked) of pairs, by their full sets; only texts in pairs are cut again."""
    pairs = persist(pairs, "pairs")
    ids = persist(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    kind = dict(rows.dtypes)["doc_id"]
    full = persist(_some(rows, ids).join(ids.hint("shuffle_hash"), "doc_id").select("doc_id", "text").mapInArrow(_sets(width), f"doc_id {kind}, hashes binary"), "sets")
    one = full.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha"))
    two = full.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"))
    out = persist(pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(_measured(percent), f"a {kind}, b {kind}, both long, linked boolean"), "measured")
    for table in (pairs, ids, full):
        drop_table(table)
    return out


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes in blocks: ids, sizes, and all sketches behind one another."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, len(batch), LISTED):
            b = batch.slice(at, LISTED)
            sketch = b.column(2)
            ends = np.asarray(sketch.value_lengths())
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made], pa.int64()), pa.array([b.column(0).to_pylist()], pa.list_(b.schema.field(0).type)), pa.array([b.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([ends.astype(np.int32).tobytes()], pa.binary()), pa.array([np.asarray(sketch.flatten()).astype(np.int64).tobytes()], pa.binary())],
                ["block", "ids", "sizes", "lengths", "values"],
            )
            made += 1


def _asked(plan: exchange.Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                distinct, counts = _distinct(values.as_py())
                yield from exchange.lists(plan, distinct, counts, block).to_batches()

    return run


def _distinct(values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct values and their counts, mixed as the exchange deals by top bits and sketches hold small values."""
    return np.unique(np.frombuffer(values, np.uint64) * MIX, return_counts=True)


def _posts(percent: int, plan: exchange.Plan):
    need = np.array([overlap_needed(n, percent) for n in range(SKETCH + 1)])

    def run(key, blocks, answers):
        kind, out = blocks.schema.field("ids").type.value_type, []
        for r in blocks.to_pylist():
            values, lengths = np.frombuffer(r["values"], np.int64), np.frombuffer(r["lengths"], np.int32)
            names, _ = _distinct(r["values"])
            held = exchange.totals(plan, names, dict(zip(answers["place"].to_pylist(), answers["totals"], strict=True)))
            held = held[np.searchsorted(names, values.view(np.uint64) * MIX)]
            row = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((values, held, row))
            rank = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = order[(rank < (lengths - need[lengths] + 1)[row[order]]) & (held[order] > 1)]
            ids, sizes = r["ids"], np.array(r["sizes"], np.int64)
            out.append(pa.table([pa.array(values[keep]), pa.array([ids[i] for i in row[keep]], kind), pa.array(sizes[row[keep]])], ["value", "doc_id", "n"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], kind), pa.array([], pa.int64())], ["value", "doc_id", "n"])

    return run


def posted(sigs: DataFrame, percent: int) -> DataFrame:
    """(value, doc_id, n): each set under the rarest of its retained values that other sets hold too.

    Sets of the wanted similarity share ``t`` retained values at least, so in any
    common order they meet within the first ``size - t + 1`` of each.
    """
    kind = dict(sigs.dtypes)["doc_id"]
    blocks = persist(sigs.select("doc_id", "n_shingles", "sketch").mapInArrow(_listing, f"block long, ids array<{kind}>, sizes array<long>, lengths binary, values binary"), "blocks")
    total, senders = blocks.agg(F.sum(F.length("values")), F.count("*")).first()
    plan = exchange.Plan((total or 0) // 8)
    answers = exchange.answered(blocks.select("block", "values").mapInArrow(_asked(plan), exchange.LISTS), plan, senders)
    asked = exchange.parted(blocks, "block", senders)
    told = exchange.parted(answers.select("place", F.col("sender").alias("block"), "totals"), "block", senders)
    out = persist(asked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_posts(percent, plan), f"value long, doc_id {kind}, n long"), "lists")
    drop_table(answers)
    drop_table(blocks)
    return out


def _pivots(lists: DataFrame) -> DataFrame:
    """(value, pivots): up to PIVOTS classes of each list, the same ones in lists of the same classes."""
    least = [F.min(F.struct(F.xxhash64("doc_id", F.lit(i)).alias("h"), F.col("doc_id").alias("d"), "n")).alias(f"p{i}") for i in range(PIVOTS)]
    found = lists.groupBy("value").agg(F.count("*").alias("listed"), *least).where("listed > 1")
    return found.select("value", F.array_distinct(F.array(*[F.struct(F.col(f"p{i}.d").alias("d"), F.col(f"p{i}.n").alias("pn")) for i in range(PIVOTS)])).alias("pivots"))


def _pivoted(lists: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of each class with its lists' pivots."""
    met = lists.join(pivots, "value").select("doc_id", "n", F.explode("pivots").alias("p")).select("doc_id", "n", "p.d", "p.pn").where((F.col("doc_id") != F.col("d")) & _alike("n", "pn", percent))
    return met.select(F.least("doc_id", "d").alias("a"), F.greatest("doc_id", "d").alias("b")).distinct()


def _meeting(table, percent: int):
    """Of a list's two blocks (or one with itself): rows of each, and which pairs may be linked.

    A pair may not if its components are the same, or its sizes or exact overlaps
    with a pivot rule the similarity out: sets that meet a pivot in p and q values
    share at most min(p, q) of them, and at most the smaller rest besides.
    """
    side = np.asarray(table["side"])
    codes: dict = {}
    comp = np.array([codes.setdefault(c, len(codes)) for c in table["component"].to_pylist()])
    size = np.asarray(table["n"])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = table["i"][0].as_py() == table["j"][0].as_py()
    right = left if same else right
    names: dict = {}
    met = [[(names.setdefault(p["d"], len(names)), p["both"]) for p in row or []] for row in table["met"].to_pylist()]
    known = np.full((len(names), len(side)), -1, np.int64)
    for i, row in enumerate(met):
        for p, both in row:
            known[p, i] = both
    good = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(left), STRIPE):
        rows = left[lo : lo + STRIPE]
        x, y = size[rows][:, None], size[right][None, :]
        may = (comp[rows][:, None] != comp[right][None, :]) & (100 * x >= percent * y) & (100 * y >= percent * x)
        need = (percent * (x + y) + 99 + percent) // (100 + percent)
        for o in known:
            p, q = o[rows][:, None], o[right][None, :]
            may &= (p < 0) | (q < 0) | (np.minimum(p, q) + np.minimum(x - p, y - q) >= need)
        good[lo : lo + STRIPE] = may
    if same:
        good &= np.tri(len(left), len(left), -1, dtype=bool)
    return left, right, good


def _partnered(percent: int):
    """Rows of a list's blocks that have a partner left: only their sets are fetched.

    A pair is left to the list of its smallest common posted value.
    """

    def run(key, table):
        left, right, good = _meeting(table, percent)
        value = key[0].as_py()
        if good.any():
            earlier = [np.array([v for v in row if v < value], np.int64) for row in table["posted"].to_pylist()]
            good &= _overlaps(earlier, left, right) == 0
        keep = np.zeros(table.num_rows, bool)
        keep[left[good.any(1)]] = True
        keep[right[good.any(0)]] = True
        return table.filter(pa.array(keep))

    return run


def _crossed(percent: int):
    """Links of two blocks of a long list across components, by full sets; a spanning forest of them.

    Pairs whose sketches, the smallest values of their sets, overlap too little
    are not compared further; nor are pairs that links found here join already.
    """

    def run(key, table):
        kind = table.schema.field("doc_id").type
        ids = table["doc_id"].to_pylist()
        left, right, good = _meeting(table, percent)
        sets = [np.frombuffer(x.as_py(), np.int64) for x in table["hashes"]]
        out = []
        if good.any():
            least = np.array([overlap_needed(min(len(s), SKETCH), percent) for s in sets])
            good &= _overlaps([s[:SKETCH] for s in sets], left, right) >= np.maximum(least[left][:, None], least[right][None, :])
            root = list(range(len(ids)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(good), strict=True):
                x, y = int(left[i]), int(right[j])
                p, q = find(x), find(y)
                if p == q:
                    continue
                n = len(sets[x]) + len(sets[y])
                both = n - len(np.unique(np.concatenate([sets[x], sets[y]])))
                if 100 * both >= percent * (n - both):
                    root[p] = q
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table([pa.array([x for x, _ in out], kind), pa.array([y for _, y in out], kind)], ["a", "b"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left and right sets."""
    values = np.concatenate(sets) if sets else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    often = count > 1
    code = np.cumsum(often) - 1
    keep = often[inverse]
    row, inverse = row[keep], code[inverse[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(inverse, kind="stable")
    row, inverse = row[order], inverse[order]
    for lo in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(inverse, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], inverse[a:b] - lo] = 1
        out += part[left] @ part[right].T
    return out


#: More than the blocks of any band.
WIDE = 1 << 40


def _crossing(lists: DataFrame, pivots: DataFrame, measured: DataFrame, comps: DataFrame, sigs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) within lists that no component joins yet: enough of them to give the components."""
    labelled = lists.join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = persist(labelled.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("listed")).where("lo < hi").select("value", "listed"), "mixed")
    met = persist(labelled.join(mixed, "value"), "mixed")
    short = met.where(F.col("listed") <= SHORT).select("value", "doc_id", "n", "component")
    mate = short.select("value", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    few = short.join(mate, [short["value"] == mate["value"], F.col("doc_id") < F.col("b"), F.col("component") != F.col("cb"), _alike("n", "nb", percent)]).select(F.col("doc_id").alias("a"), "b").distinct()
    few = few.join(measured.select("a", "b"), ["a", "b"], "left_anti")
    few = _measure(_filtered(few, sigs, percent), rows, width, percent).where("linked").select("a", "b")
    long = met.where(F.col("listed") > SHORT)
    if long.isEmpty():
        return few
    kind = dict(rows.dtypes)["doc_id"]
    # What is known of each class and its lists' pivots.
    twice = measured.select(F.col("a").alias("doc_id"), F.col("b").alias("d"), "both").unionByName(measured.select(F.col("b").alias("doc_id"), F.col("a").alias("d"), "both"))
    asked = long.select("value", "doc_id", "n").join(pivots, "value").select("doc_id", "n", F.array_sort("pivots.d").alias("d")).distinct()
    asked = asked.groupBy("doc_id", "n").agg(F.array_distinct(F.flatten(F.collect_list("d"))).alias("d")).select("doc_id", "n", F.explode("d").alias("d"))
    known = asked.join(twice, ["doc_id", "d"], "left").withColumn("both", F.when(F.col("doc_id") == F.col("d"), F.col("n")).otherwise(F.col("both"))).where("both IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.collect_list(F.struct("d", "both")).alias("met"))
    every = long.groupBy("doc_id").agg(F.collect_set("value").alias("posted"))
    # Blocks are numbered by band, then within it. A block meets itself, the others of its band and those of the bands beside it; of two blocks the lower is side 0.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND) + 1e-9).cast("long")
    banded = long.withColumn("band", band)
    bands = banded.groupBy("value", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    bands = persist(bands.groupBy("value").agg(F.collect_list(F.struct("band", "blocks")).alias("bands")), "bands")
    beside = F.filter("bands", lambda x: F.abs(x["band"] - F.col("band")) <= 1)
    own = F.element_at(F.filter("bands", lambda x: x["band"] == F.col("band")), 1)["blocks"]
    others = F.flatten(F.transform(beside, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["blocks"] - 1), lambda i: x["band"] * WIDE + i)))
    dealt = long.join(known, "doc_id", "left").join(every, "doc_id").withColumn("band", band).join(bands, "value")
    dealt = dealt.withColumn("block", F.col("band") * WIDE + F.pmod(F.xxhash64("doc_id", F.lit("block")), own)).withColumn("other", F.explode(others)).drop("bands")
    # First without sets: what sizes, components, pivots and other lists rule out need not be fetched.
    light = dealt.select("value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "n", "component", (F.col("block") > F.col("other")).cast("int").alias("side"), "met", "posted")
    light = persist(light.groupBy("value", "i", "j").applyInArrow(_partnered(percent), light.schema).drop("posted"), "partnered")
    ids = persist(light.select("doc_id").distinct(), "ids")
    full = _some(rows, ids).join(ids.hint("shuffle_hash"), "doc_id").select("doc_id", "text").mapInArrow(_sets(width, False), f"doc_id {kind}, hashes binary")
    many = light.join(full, "doc_id").groupBy("value", "i", "j").applyInArrow(_crossed(percent), f"a {kind}, b {kind}")
    return few.unionByName(many)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets
    of ``width``-word shingles; ``component_id`` is the smallest id reachable.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    sigs = persist(rows.mapInArrow(_sketched(width), f"doc_id {kind}, n_shingles long, print binary, sketch array<long>"), "sketches")
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("print", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch"))
    reps = persist(classes.withColumnRenamed("class_id", "doc_id"), "classes")
    members = persist(sigs.drop("sketch"), "members")
    drop_table(sigs)
    lists = posted(reps, percent)
    pivots = persist(_pivots(lists), "pivots")
    measured = _measure(_filtered(_pivoted(lists, pivots, percent), reps, percent), rows, width, percent)
    first = measured.where("linked").select("a", "b")
    comps = persist(components(first), "components")
    second = persist(_crossing(lists, pivots, measured, comps, reps, rows, width, percent), "second")
    if not second.isEmpty():
        comps = persist(components(first.unionByName(second)), "components")
    named = reps.select(F.col("print").alias("p"), F.col("n_shingles").alias("n"), F.col("doc_id").alias("node")).join(comps, "node", "left").select("p", "n", F.coalesce("component", "node").alias("component_id"))
    named = persist(named, "named")
    out = members.join(named, [F.col("print") == F.col("p"), F.col("n_shingles") == F.col("n")], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns as they were: that of the smallest id, null ids last.

    Rows are told apart by id and text: rows that share an id, or have none, are
    linked by their own texts and nothing else.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), mark(text_col).alias("mark")).withColumn("row", F.xxhash64("doc_id", "mark"))
    judged = persist(near_duplicates(rows, width, percent, "row").select("doc_id", "component_id").distinct(), "judged")
    several = judged.where("doc_id != component_id").select(F.col("component_id").alias("c")).distinct()
    judged = judged.join(several, judged.component_id == several.c).select(F.col("doc_id").alias("node"), "component_id")
    # Every row of these components, a repeated one once.
    named = persist(_some(rows.select(F.col("row").alias("doc_id"), "text", F.col("doc_id").alias("id"), "mark"), judged.select(F.col("node").alias("doc_id")), ["id", "mark"]).join(judged, F.col("doc_id") == F.col("node")).groupBy("component_id", "id", "mark").agg(F.count("*").alias("n")), "named")
    best = persist(named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark")).alias("best")), "best")
    chosen = named.join(best, "component_id")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    gone = persist(chosen.where(~stays).select("id", "mark").distinct(), "gone")
    # A row that is repeated as it is has no link to itself, but its copies go too.
    again = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "mark")
    return once(without(docs, gone, id_col, text_col), persist(again, "again"), id_col, text_col)
