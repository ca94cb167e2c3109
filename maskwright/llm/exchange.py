"""Counts of keys that are spread over many tasks, added up and told back to each.

A sender - a block of a corpus - lists its distinct keys (64-bit hashes, of one
of several kinds) with counts.  Lists are dealt by key to shards; a shard adds
the counts and answers each sender with the totals in the order in which it
listed the keys.  So a key however frequent costs one entry a sender, and nobody
holds all keys.

A sender writes to at most ``FAN`` places.  Where more shards are needed, lists go
there in several hops: up to ``FAN`` senders' lists for one place are merged into
one, which is cut into ``FAN`` finer ones, and totals come back the same way.  So
rows grow with the senders, at most FAN a sender, kind and hop, not with senders
times shards.

Shuffled rows are arrays: keys of 8 bytes, or of 6 on the last hop for kinds that
allow it (with the shard, which is made of the top bits, they keep 48 bits and
more), and counts compressed.  Every table between the hops lies in the shared
folder.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import persist

#: Places that one sender's lists go to, and senders' lists that one place merges, at most.
FAN = 256
#: Entries of a shard, about.
SHARD_KEYS = 1_000_000


class Plan:
    """Fan and hops for so many entries; how wide keys of a kind (0 up to ``kinds``) must stay on the last hop."""

    def __init__(self, entries: int, kinds: int = 1, width: Callable[[int], int] = lambda kind: 8):
        self.kinds, self.widths = kinds, [width(k) for k in range(kinds)]
        shards = max(1, math.ceil(entries / SHARD_KEYS))
        self.hops = self.fan = 1
        while FAN**self.hops < shards:
            self.hops += 1
        while self.fan**self.hops < shards:
            self.fan += 1

    def width(self, kind: int, hop: int) -> int:
        return self.widths[kind] if hop == self.hops - 1 else 8


def dealt(keys: np.ndarray, fan: int, hop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(digit, positions of its keys in their order): where keys go at a hop, by their top bits."""
    digit = ((keys >> np.uint64(40)) // np.uint64(fan**hop) % np.uint64(fan)).astype(np.uint16)
    order = np.argsort(digit, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(digit[order])) + 1):
        if len(part):
            yield int(digit[part[0]]), part


def _packed(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(data, np.uint64)
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


def _numbers(counts: np.ndarray) -> bytes:
    """Counts in 32 bits, or 64 where they need them, told by the first byte."""
    wide = len(counts) and counts.max() >= 2**32
    return bytes([8 if wide else 4]) + zlib.compress(counts.astype(np.uint64 if wide else np.uint32).tobytes(), 1)


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), np.uint64 if data[0] == 8 else np.uint32)


#: ``place`` tells the way so far and the kind.
LISTS = "place long, sender long, keys binary, counts binary"
#: ``seen``: keys of kind 0 with a total above 0, told once a shard.
ANSWERS = "place long, sender long, totals binary, seen long"


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = [pa.int64() if x.split()[1] == "long" else pa.binary() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])


def lists(plan: Plan, keys: np.ndarray, counts: np.ndarray, sender: int, kind: int = 0, path: int = 0, hop: int = 0) -> pa.Table:
    """A sender's list of one kind, as rows of LISTS."""
    return _rows([((path * plan.fan + d) * plan.kinds + kind, sender, _packed(keys[part], plan.width(kind, hop)), _numbers(counts[part])) for d, part in dealt(keys, plan.fan, hop)], LISTS)


def totals(plan: Plan, keys: np.ndarray, answers: dict[int, pa.BinaryScalar], kind: int = 0, path: int = 0, hop: int = 0) -> np.ndarray:
    """The totals of a sender's keys, from the answers by place."""
    out = np.zeros(len(keys), np.int64)
    for d, part in dealt(keys, plan.fan, hop):
        out[part] = _counts(answers[(path * plan.fan + d) * plan.kinds + kind].as_py())
    return out


class _Merged:
    """The union of several senders' lists for one place, and where each sender's keys are in it."""

    def __init__(self, table: pa.Table, width: int):
        self.senders = table["sender"].to_pylist()
        keys = [_unpacked(x.as_py(), width) for x in table["keys"]]
        self.cuts = np.cumsum([len(x) for x in keys])[:-1]
        self.keys, self.where = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        counts = np.concatenate([_counts(x.as_py()) for x in table["counts"]])
        self.counts = np.bincount(self.where, counts, len(self.keys)).astype(np.int64)

    def answers(self, place: int, found: np.ndarray, seen: int) -> pa.Table:
        """Each sender's totals in its own order."""
        rows = [(place, sender, _numbers(found[x]), 0) for sender, x in zip(self.senders, np.split(self.where, self.cuts), strict=True)]
        rows[0] = (*rows[0][:3], seen)
        return _rows(rows, ANSWERS)


def _added(plan: Plan):
    def run(key, table):
        kind = key[0].as_py() % plan.kinds
        m = _Merged(table, plan.width(kind, plan.hops - 1))
        return m.answers(key[0].as_py(), m.counts, int((m.counts > 0).sum()) if kind == 0 else 0)

    return run


def _merge(plan: Plan, hop: int):
    """One list of several senders' lists, dealt out for the next hop."""

    def run(key, table):
        path, kind = divmod(key[0].as_py(), plan.kinds)
        m = _Merged(table, 8)
        return lists(plan, m.keys, m.counts, key[1].as_py(), kind, path, hop + 1)

    return run


def _spread(plan: Plan, hop: int):
    """The totals of a merged list, passed on to its senders."""

    def run(key, table, answers):
        path, kind = divmod(key[0].as_py(), plan.kinds)
        m = _Merged(table, 8)
        got = dict(zip(answers["place"].to_pylist(), answers["totals"], strict=True))
        return m.answers(key[0].as_py(), totals(plan, m.keys, got, kind, path, hop + 1), sum(answers["seen"].to_pylist()))

    return run


def answered(sent: DataFrame, plan: Plan, senders: int, hop: int = 0) -> DataFrame:
    """Rows of ANSWERS for the rows of LISTS that so many senders sent."""
    if hop == plan.hops - 1:
        return persist(sent.groupBy("place").applyInArrow(_added(plan), ANSWERS), "totals")
    groups = -(-senders // plan.fan)
    # Senders are dealt to groups by a hash; groups are numbered densely.
    group = F.pmod(F.xxhash64("sender"), F.lit(groups)) if hop == 0 else F.floor(F.col("sender") / plan.fan)
    sent = persist(sent.withColumn("team", group.cast("long")), "lists")
    merged = sent.groupBy("place", "team").applyInArrow(_merge(plan, hop), LISTS)
    up = answered(merged, plan, groups, hop + 1)
    above = F.floor(F.floor(F.col("place") / plan.kinds) / plan.fan) * plan.kinds + F.col("place") % plan.kinds
    up = up.withColumn("above", above.cast("long"))
    return persist(sent.groupBy("place", "team").cogroup(up.groupBy("above", "sender")).applyInArrow(_spread(plan, hop), ANSWERS), "totals")


def parted(df: DataFrame, key: str, rows: int, each: int = 4) -> DataFrame:
    """``df`` of so many large rows, by ``key`` in partitions of about ``each``, if the session's number is too small for that."""
    n = -(-rows // each)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
