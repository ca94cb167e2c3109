"""Language-model scoring with a weighted backoff automaton.

Tokens are words and one end a text.  The model interpolates n-grams of up to
``order`` words with Dirichlet smoothing,

    P(w | h) = (c(h w) + mu * P(w | h')) / (c(h) + mu),

where h' drops h's oldest word and P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).
Learnt n-grams are states; a state has an arc for each word that was seen after
it, and one failure arc to the state of h' that costs log10(mu / (c(h) + mu)).
A text is scored in one traversal from left to right: follow failure arcs until
the word has an arc, add up the logarithms, and carry the state on.

The counts grow with the corpus, so no task holds the model.  Documents are
packed into blocks; a block lists the distinct n-grams of its documents, with
its training counts, once.  The lists are shuffled by n-gram to shards which add
the counts and send the totals back, in the order in which the block listed
them.  A block then has exactly the part of the automaton that its texts can
visit.

    blocks (one narrow pass, written)  ->  lists by shard  ->  totals by block
    blocks + totals (cogrouped by block)  ->  scores

:mod:`maskwright.llm.exchange` does that in hops of bounded fan, so rows grow with
the blocks: 1 TB of text has 250,000 blocks and 170,000 shards of 1 million
entries a word order, and so three hops of at most 250,000 * 56 = 14 million rows
an order (their fan being the cube root of the shards).

Scale: rows that are shuffled are arrays of 6-byte keys, sorted, so they stay
near 7 bytes a distinct n-gram and block; a word however frequent has one entry
a block.  Blocks hold ``BLOCK_BYTES`` of text and shards about a million
entries, both bounded however large the input is; a single text longer than a
block is a block of its own.  Every table between the steps lies in the shared
folder.

N-grams are told apart by hashes: words by 64 bits, longer ones by 48 bits beside
their shard's number.  Two that share a hash would be one n-gram with both their
counts: in a shard of 1 million keys that happens to one pair with a chance of
0.002, so about one n-gram in a billion gets another one's counts added.

Defined cases: null and empty texts are one end token; with nothing learnt every
token has probability 1; repeated rows are counted and scored again; null ids
count as empty text in the fold; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm import exchange
from maskwright.llm.common import fold, id_and_text, persist

ORDER = 2
MU = 256.0
BLOCK_BYTES = 4 << 20
#: Hashes of what isn't a word of a text: no word holds a space.
END, START = (xxhash.xxh3_64_intdigest(x) for x in (b"the end", b"the start"))
KEY_BYTES = 6


def _blocks(block_bytes: int):
    """Documents as word numbers, the words as hashes, a row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number: dict[bytes, int] = {}
        ids, train, lengths, codes = [], [], [], []
        size = made = 0
        kind = None

        def row() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
            hashes = np.concatenate([np.array([END, START], np.uint64), hashes])
            wide = np.concatenate(codes).astype(np.uint32 if len(hashes) > 65536 else np.uint16)
            cells = [(part << 32) + made, hashes.tobytes(), wide.tobytes(), np.array(lengths, np.int64).tobytes(), np.array(train, np.bool_).tobytes(), len(wide), int(sum(n for n, t in zip(lengths, train, strict=True) if t)), sum(train)]
            kinds = [pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 3]
            arrays = [pa.array([c], k) for c, k in zip(cells, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([ids], pa.list_(kind))], ["block", "words", "codes", "lengths", "train", "n_tokens", "n_train", "train_docs", "ids"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, text, use in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py()
                found = raw.lower().split()
                for w in found:
                    if w not in number:
                        number[w] = len(number) + 2
                found = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
                codes.append(np.append(found, 0).astype(np.uint32))
                ids.append(name)
                train.append(use)
                lengths.append(len(found) + 1)
                size += len(raw) + 64
                if size >= block_bytes:
                    yield row()
                    number, size, made = {}, 0, made + 1
                    ids, train, lengths, codes = [], [], [], []
        if ids:
            yield row()

    return run


class Block:
    """A block's texts and its distinct n-grams of each order, in a fixed order.

    ``keys[k]`` are the hashes of the distinct (k + 1)-grams, ``at[k]`` the gram
    that ends at each place (-1 where it would begin before the text), and
    ``context[k]``/``suffix[k]`` the (k)-grams without the last or first word.
    """

    def __init__(self, words: bytes, codes: bytes, lengths: bytes, train: bytes, order: int):
        self.words = np.frombuffer(words, np.uint64)
        token = np.frombuffer(codes, np.uint32 if len(self.words) > 65536 else np.uint16)
        self.lengths, self.train = np.frombuffer(lengths, np.int64), np.frombuffer(train, np.bool_)
        n, docs = len(token), len(self.lengths)
        # A start stands before each text; it is a context, never a token.
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.starts = self.begins + np.arange(docs)
        text = np.ones(n + docs, np.int32)
        text[np.arange(n) + np.repeat(np.arange(1, docs + 1), self.lengths)] = token
        self.token = token
        learnt = np.repeat(self.train, self.lengths + 1)
        since = np.arange(n + docs, dtype=np.int32) - np.repeat(self.starts, self.lengths + 1).astype(np.int32)
        self.at, self.keys, self.counts, self.context, self.suffix = [text], [self.words], [_count(text, learnt, len(self.words))], [None], [None]
        for k in range(1, order):
            ok = np.flatnonzero(since >= k)
            pair = self.at[-1][ok - 1] * np.int64(len(self.words)) + text[ok]
            distinct, where = np.unique(pair, return_inverse=True)
            del pair
            context, word = (x.astype(np.int32) for x in np.divmod(distinct, len(self.words)))
            suffix = np.empty(len(distinct), np.int32)
            suffix[where] = self.at[-1][ok]
            mixed = (self.keys[-1][context] * np.uint64(0x9E3779B97F4A7C15)) ^ (self.words[word] + np.uint64(k))
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            now = np.full(n + docs, -1, np.int32)
            now[ok] = where
            self.at.append(now)
            self.keys.append(mixed)
            self.counts.append(_count(where, learnt[ok], len(distinct)))
            self.context.append(context)
            self.suffix.append(suffix)


def _count(codes: np.ndarray, use: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(codes[use], minlength=n).astype(np.uint32)


def _width(k: int) -> int:
    """Words keep all 64 bits, as their counts are results; longer grams 48 beside their shard."""
    return KEY_BYTES if k else 8


def _lists(order: int, plan: exchange.Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, *parts = (batch.column(j)[i].as_py() for j in range(5))
                b = Block(*parts, order)
                for k in range(order):
                    yield from exchange.lists(plan, b.keys[k], b.counts[k], block, k).to_batches()

    return run


class Automaton:
    """The part of the backoff automaton that one block's texts can visit.

    A state of depth k is a learnt k-gram, the empty one at depth 0.  ``seen[k]``
    tells which (k + 1)-grams are arcs from depth k, ``log[k]`` what they cost,
    and ``cost[k]`` what the failure arc of each k-gram costs.  ``Block.at``
    resolves, for each place of a text, which arc a depth could take there.
    """

    def __init__(self, b: Block, totals: list[np.ndarray], order: int, mu: float, base: np.ndarray):
        self.order, self.b = order, b
        self.seen, self.log, self.cost = [totals[0] > 0], [np.log10(base)], [np.zeros(0)]
        prob = base
        for k in range(1, order):
            lower = totals[k - 1].astype(float)
            self.cost.append(np.log10(mu / (lower + mu)))
            prob = (totals[k] + mu * prob[b.suffix[k]]) / (lower[b.context[k]] + mu)
            self.seen.append(totals[k] > 0)
            self.log.append(np.log10(prob))

    def score(self, doc: int) -> float:
        """One traversal of a text from left to right: its log10 probability.

        The state's depth is carried; the state itself is the gram of that depth
        that ends at the place before.
        """
        b, top = self.b, self.order - 1
        lo = int(b.starts[doc])
        here = slice(lo + 1, lo + 1 + int(b.lengths[doc]))
        before = slice(here.start - 1, here.stop - 1)
        arcs, logs, fails = [], [], [()]
        for k in range(self.order):
            at = b.at[k][here]
            arcs.append((self.seen[k][at] & (at >= 0)).tolist())
            logs.append(self.log[k][at].tolist())
            if k:
                fails.append(self.cost[k][b.at[k - 1][before]].tolist())
        root, first = arcs[0], logs[0]
        depth = int(top > 0 and bool(self.seen[0][1]))
        total = 0.0
        for i, known in enumerate(root):
            k = depth
            while k and not arcs[k][i]:
                total += fails[k][i]
                k -= 1
            total += logs[k][i] if k else first[i]
            depth = (k + 1 if k < top else top) if known else 0
        return total


def _scores(order: int, plan: exchange.Plan, mu: float, n: int, v: int):
    def run(key, blocks, answers):
        kind = blocks.schema.field("ids").type.value_type
        if not blocks.num_rows:
            return pa.table([pa.array([], kind), pa.array([], pa.bool_()), *[pa.array([], pa.int64())] * 2, *[pa.array([], pa.float64())] * 2], OUT)
        b = Block(*(blocks[c][0].as_py() for c in ("words", "codes", "lengths", "train")), order)
        got = dict(zip(answers["place"].to_pylist(), answers["totals"], strict=True))
        totals = [exchange.totals(plan, keys, got, k) for k, keys in enumerate(b.keys)]
        del got
        base = (totals[0] + 0.1) / (n + 0.1 * (v + 1))
        auto = Automaton(b, totals, order, mu, base)
        known = (totals[0] > 0)[b.token]
        sums = np.add.reduceat(np.log10(base)[b.token], b.begins)
        hits = np.add.reduceat(known.astype(np.int64), b.begins)
        scores = [auto.score(i) for i in range(len(b.lengths))]
        return pa.table([blocks["ids"].combine_chunks().flatten(), pa.array(~b.train), pa.array(b.lengths), pa.array(hits), pa.array(sums), pa.array(scores, pa.float64())], OUT)

    return run


OUT = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]


def score(docs: DataFrame, learn: Column | None = None, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``learn``: a condition over doc_id for the documents whose counts make the model.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("learn", F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)))
    kind = dict(rows.dtypes)["doc_id"]
    blocks = persist(rows.mapInArrow(_blocks(block_bytes), f"block long, words binary, codes binary, lengths binary, train binary, n_tokens long, n_train long, train_docs long, ids array<{kind}>"), "blocks")
    sizes = blocks.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("train_docs"), F.count("*")).first()
    tokens, n, learnt, senders = (x or 0 for x in sizes)
    plan = exchange.Plan(tokens, order, _width)
    lists = blocks.select("block", "words", "codes", "lengths", "train").mapInArrow(_lists(order, plan), exchange.LISTS)
    answers = exchange.answered(lists, plan, senders)
    # The start of texts is listed among the words, but is none.
    v = (answers.agg(F.sum("seen")).first()[0] or 0) - (learnt > 0)
    asked = exchange.parted(blocks, "block", senders)
    told = exchange.parted(answers.select("place", F.col("sender").alias("block"), "totals"), "block", senders)
    out = asked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scores(order, plan, mu, n, v), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Learns from ids whose crc32 mod 10 isn't 0 and scores every text."""
    return score(docs, fold("doc_id", 10) != 0)
