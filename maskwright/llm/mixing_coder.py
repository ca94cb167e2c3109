"""Adaptive context-mixing range coder for token ids.

A block codes up to ``BLOCK_IDS`` ids of at most ``DISTINCT`` kinds and knows
nothing of other blocks: its models start fresh and a checksum guards its ids.
The block opens with its distinct ids; what is coded are their ranks.  Its
sequence is cut into up to ``LANES`` stretches that share the block's models and
are coded in step, as numpy vectors: each step codes the next id of every
stretch, so the models learn from all of them at once.

Three predictions are mixed:

* order 2: the id that last followed the two ids before, and how often in a row;
* order 1: the id that last followed the id before, likewise;
* order 0: each id's share of the block so far.

The chance that the order-2 guess is right, and that the order-1 guess is right
if that one is wrong, are mixed in the logistic domain from the hit rates at the
order-2 confidence, at the order-1 confidence and at the guess's order-0 share,
with weights that learn from the outcomes; what the very context has shown so
far then refines the mixture.  The outcome is one range-coded symbol of three.
An id that neither order guessed follows by the order-0 counts of such ids.

Contexts are few (``CONTEXTS``), so probabilities are tables that are made anew
after every few thousand ids; a step only looks them up.  All arithmetic is in
integers (a quotient below 2^16 of integers below 2^48 is exact in doubles), so
any machine decodes what another encoded.

Block bytes: ids, stretches, distinct ids, bytes of the dictionary (4 each),
crc32 of all that follows and of the ids as little-endian 32-bit numbers (4),
the dictionary (zlib over gaps), 16-bit digits of each stretch (2 each), the
digits.  A damaged block
raises ``ValueError``.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK_IDS = 1 << 20
DISTINCT = 1 << 15
LANES = 4096
#: Ids of a stretch, at least: what its last digit and its length cost is shared by them.
STRETCH_IDS = 128
#: Order-2 contexts are hashed to so many places.
PLACES = 1 << 17
#: Ids after which the tables are made anew, at most; a young block's are made anew sooner.
REFRESH = 1 << 16
SURE = 7
#: Confidence of both orders (3 bits each), whether they agree, order-0 shares of both guesses (2 bits each).
CONTEXTS = 1 << 11
#: So many outcomes weigh the mixture against what a context itself has shown.
PRIOR = 24
TOTAL = 1 << 16
MAX_ID = (1 << 32) - 1
HEAD = struct.Struct("<IIIII")


def _squash_table() -> np.ndarray:
    """Probability (1..4095 of 4096) of a logit in 1/256, from -2047 to 2047."""
    return np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)


SQUASH = _squash_table()
#: The logit of a probability: the inverse of the squash table, in integers.
STRETCH = (np.searchsorted(SQUASH, np.arange(4096)) - 2047).clip(-2047, 2047)

_context = np.arange(CONTEXTS)
SURE_2, SURE_1, AGREE, SHARE_2, SHARE_1 = _context >> 8, _context >> 5 & 7, _context >> 4 & 1, _context >> 2 & 3, _context & 3


class _Flag:
    """Mixes the chance of one outcome, for every context, from three rates."""

    def __init__(self, keys: list[np.ndarray]):
        self.keys = keys
        self.hits = [np.full(int(k.max()) + 1, 1, np.int64) for k in keys]
        self.tries = [np.full(len(h), 2, np.int64) for h in self.hits]
        self.weights = np.full((2, 3), 26000, np.int64)
        self.own_hits, self.own_tries = np.zeros(CONTEXTS, np.int64), np.zeros(CONTEXTS, np.int64)

    def chances(self) -> np.ndarray:
        """Chance of each context, of 4096 parts of 256."""
        self.logits = np.stack([STRETCH[(h * 4096 // t).clip(1, 4095)][k] for k, h, t in zip(self.keys, self.hits, self.tries, strict=True)])
        self.mixed = SQUASH[((self.weights[AGREE].T * self.logits).sum(0) >> 16).clip(-2047, 2047) + 2047]
        return (self.own_hits * (4096 * 256) + PRIOR * 256 * self.mixed) // (self.own_tries + PRIOR)

    def learn(self, hits: np.ndarray, tries: np.ndarray) -> None:
        error = hits * 4096 - tries * self.mixed
        for a in (0, 1):
            n = int(tries[AGREE == a].sum())
            if n:
                slope = (self.logits[:, AGREE == a] * error[AGREE == a]).sum(1) // n
                self.weights[a] = (self.weights[a] + (slope * 3 >> 6)).clip(-(1 << 17), 1 << 17)
        for k, h, t in zip(self.keys, self.hits, self.tries, strict=True):
            h += np.bincount(k, hits, len(h)).astype(np.int64)
            t += np.bincount(k, tries, len(t)).astype(np.int64)
        self.own_hits += hits
        self.own_tries += tries


class _Lanes:
    """Models of a block, and the coder state of its stretches."""

    def __init__(self, n: int, lanes: int, kinds: int):
        self.n, self.lanes, self.kinds = n, lanes, kinds
        self.steps = -(-n // lanes)
        self.full = n - (lanes - 1) * self.steps  # steps of the last stretch, the only shorter one
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.after = np.zeros(kinds, np.int64)  # rank << 3 | confidence
        self.after_two = np.zeros(PLACES, np.int64)
        self.flags = _Flag([SURE_2, SURE_1 << 1 | AGREE, SHARE_2]), _Flag([SURE_2, SURE_1, SHARE_1])
        self.all, self.missed = np.ones(kinds, np.int64), np.ones(kinds, np.int64)
        self.range = np.full(lanes, 1 << 48, np.int64)
        self.contexts, self.outcomes, self.ranks, self.misses = [], [], [], []
        self.tables()

    def tables(self) -> None:
        """Probabilities of all contexts and order-0 ranges, from what was counted so far."""
        two, one = (f.chances() for f in self.flags)
        self.end_two = (two * TOTAL // (4096 * 256)).clip(1, TOTAL - 2)
        rest = TOTAL - self.end_two
        width = (one * rest // (4096 * 256)).clip(1, rest - 1)
        self.end_one = np.where(AGREE, self.end_two, self.end_two + width)
        share = self.all * 4096 // int(self.all.sum())
        # Under 1/1024, 1/256, 1/64, and above.
        self.share = np.searchsorted([4, 16, 64], share, side="right")
        width = 1 + self.missed * (TOTAL - self.kinds) // int(self.missed.sum())
        width[int(np.argmax(width))] += TOTAL - int(width.sum())
        self.starts = np.concatenate([[0], np.cumsum(width)])
        self.slots = np.repeat(np.arange(self.kinds), width)

    def refresh(self) -> None:
        seen = np.bincount(np.concatenate(self.contexts) * 3 + np.concatenate(self.outcomes), minlength=3 * CONTEXTS).reshape(-1, 3)
        tries = seen.sum(1)
        self.flags[0].learn(seen[:, 0], tries)
        self.flags[1].learn(np.where(AGREE, 0, seen[:, 1]), np.where(AGREE, 0, tries - seen[:, 0]))
        self.all += np.bincount(np.concatenate(self.ranks), minlength=self.kinds)
        if self.misses:
            self.missed += np.bincount(np.concatenate(self.misses), minlength=self.kinds)
        self.contexts, self.outcomes, self.ranks, self.misses = [], [], [], []
        self.tables()

    def run(self) -> None:
        due = 0
        for t in range(self.steps):
            m = self.lanes if t < self.full else self.lanes - 1
            self.step(t, m)
            due += m
            if due * 4 >= min(t * self.lanes, 4 * REFRESH):
                self.refresh()
                due = 0

    def step(self, t: int, m: int) -> None:
        one, two = self.one[:m], self.two[:m]
        place = ((one << 15 | two) * 2654435761 >> 24) & (PLACES - 1)
        first, second = self.after[one], self.after_two[place]
        guess_1, sure_1, guess_2, sure_2 = first >> 3, first & SURE, second >> 3, second & SURE
        context = (((sure_2 << 3 | sure_1) << 1 | (guess_1 == guess_2)) << 2 | self.share[guess_2]) << 2 | self.share[guess_1]
        rank, outcome = self.code(t, m, guess_2, guess_1, self.end_two[context], self.end_one[context])
        right = outcome == 0  # 1: order 1 was right, 2: neither
        self.after_two[place] = np.where(right, second + (sure_2 < SURE), np.where(sure_2 > 1, guess_2 << 3 | sure_2 >> 1, rank << 3))
        right = rank == guess_1
        self.after[one] = np.where(right, first + (sure_1 < SURE), np.where(sure_1 > 1, guess_1 << 3 | sure_1 >> 1, rank << 3))
        self.contexts.append(context)
        self.outcomes.append(outcome)
        self.ranks.append(rank)
        self.two[:m] = one
        self.one[:m] = rank


def _ends(hit: np.ndarray, miss: np.ndarray, end_two: np.ndarray, end_one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the outcome's range starts and stops: 0, end_two, end_one and TOTAL part the three."""
    start = np.where(miss, end_one, end_two)
    stop = np.where(hit, end_two, end_one)
    start[hit] = 0
    stop[miss] = TOTAL
    return start, stop


class _Encoder(_Lanes):
    def __init__(self, ranks: np.ndarray, lanes: int, kinds: int):
        super().__init__(len(ranks), lanes, kinds)
        padded = np.zeros(self.steps * lanes, np.int64)
        padded[: self.n] = ranks
        self.at = np.ascontiguousarray(padded.reshape(lanes, self.steps).T)
        self.low = np.zeros(lanes, np.int64)
        #: Digits by place, then stretch; a carry stays in its digit's 17th bit until the end.
        self.out = np.zeros((2 * self.steps + 2) * lanes, np.uint32)
        self.pos = np.arange(lanes)  # place of a stretch's next digit in ``out``: a row of ``lanes`` on from the last
        self.run()
        self.out[self.pos] = (self.low + 0xFFFFFFFF) >> 32
        self.pos = self.pos // lanes + 1
        self.out = self.out.reshape(-1, lanes)
        for i in range(len(self.out) - 1, 0, -1):
            self.out[i - 1] += self.out[i] >> 16
        self.out &= 0xFFFF

    def code(self, t, m, guess_2, guess_1, end_two, end_one):
        rank = self.at[t, :m]
        hit, miss = rank == guess_2, (rank != guess_2) & (rank != guess_1)
        start, stop = _ends(hit, miss, end_two, end_one)
        low, width, pos = self.narrow(self.low[:m], self.range[:m], self.pos[:m], start, stop)
        at = np.flatnonzero(miss)
        if len(at):
            lost = rank[at]
            low[at], width[at], pos[at] = self.narrow(low[at], width[at], pos[at], self.starts[lost], self.starts[lost + 1])
            self.misses.append(lost)
        self.low[:m], self.range[:m], self.pos[:m] = low, width, pos
        return rank, 1 + miss - hit

    def narrow(self, low, width, pos, start, stop):
        part = width >> 16
        low = low + start * part
        width = (stop - start) * part
        full = np.flatnonzero(width < 1 << 32)
        due, at = low[full], pos[full]
        self.out[at] = due >> 32
        low[full] = (due & 0xFFFFFFFF) << 16
        width[full] <<= 16
        pos = pos.copy()
        pos[full] = at + self.lanes
        return low, width, pos


class _Decoder(_Lanes):
    def __init__(self, n: int, lanes: int, kinds: int, lengths: np.ndarray, digits: np.ndarray):
        # Behind its last digit a stretch reads zeros.
        self.data = np.zeros(len(digits) + 3 * lanes + 3, np.int64)
        before = np.cumsum(lengths) - lengths
        gap = 3 * np.arange(lanes)
        self.data[np.arange(len(digits)) + np.repeat(gap, lengths)] = digits
        self.pos = before + gap
        self.value = self.data[self.pos] << 32 | self.data[self.pos + 1] << 16 | self.data[self.pos + 2]
        self.pos += 3
        super().__init__(n, lanes, kinds)
        self.at = np.zeros((self.steps, lanes), np.int64)
        self.run()

    def code(self, t, m, guess_2, guess_1, end_two, end_one):
        value, width, pos = self.value[:m], self.range[:m], self.pos[:m]
        part = width >> 16
        goal = (value / part).astype(np.int64)
        hit, miss = goal < end_two, goal >= end_one
        start, stop = _ends(hit, miss, end_two, end_one)
        value, width, pos = self.narrow(value, part, pos, start, stop)
        rank = np.where(hit, guess_2, guess_1)
        at = np.flatnonzero(miss)
        if len(at):
            part = width[at] >> 16
            lost = self.slots[(value[at] / part).astype(np.int64).clip(0, TOTAL - 1)]
            value[at], width[at], pos[at] = self.narrow(value[at], part, pos[at], self.starts[lost], self.starts[lost + 1])
            rank[at] = lost
            self.misses.append(lost)
        self.value[:m], self.range[:m], self.pos[:m] = value, width, pos
        self.at[t, :m] = rank
        return rank, 1 + miss - hit

    def narrow(self, value, part, pos, start, stop):
        value = value - start * part
        width = (stop - start) * part
        full = np.flatnonzero(width < 1 << 32)
        # A damaged block may ask for more digits than there are, or be far outside its range; its checksum then fails.
        at = pos[full]
        value[full] = (value[full] << 16 | self.data.take(at, mode="clip")) & 0xFFFFFFFFFFFF
        width[full] <<= 16
        pos = pos.copy()
        pos[full] = at + 1
        return value, width, pos


def _lanes(n: int) -> int:
    """Stretches of a block of n ids; each but the last is equally long, and none is empty."""
    steps = max(STRETCH_IDS, -(-n // LANES))
    return -(-n // steps)


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and each id's place among them."""
    if ids.max() > 1 << 20:
        return np.unique(ids, return_inverse=True)
    kinds = np.flatnonzero(np.bincount(ids))
    place = np.zeros(int(kinds[-1]) + 1, np.int64)
    place[kinds] = np.arange(len(kinds))
    return kinds, place[ids]


def _block(ids: np.ndarray) -> bytes:
    kinds, ranks = _ranked(ids)
    e = _Encoder(ranks, _lanes(len(ids)), len(kinds))
    dictionary = zlib.compress(np.diff(kinds, prepend=0).astype("<u4").tobytes(), 6)
    digits = e.out.T[np.arange(len(e.out)) < e.pos[:, None]]
    body = dictionary + e.pos.astype("<u2").tobytes() + digits.astype("<u2").tobytes()
    return HEAD.pack(len(ids), e.lanes, len(kinds), len(dictionary), _checksum(body, ids)) + body


def _checksum(body: bytes, ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), zlib.crc32(body))


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> list[bytes]:
    """Blocks of a sequence of ids below 2^32."""
    if len(ids) and (ids.min() < 0 or ids.max() > MAX_ID):
        raise ValueError("ids must be between 0 and 2^32 - 1")
    out, at = [], 0
    while at < len(ids):
        n = min(block_ids, len(ids) - at)
        while n > DISTINCT and len(_ranked(ids[at : at + n])[0]) > DISTINCT:
            n //= 2
        out.append(_block(np.asarray(ids[at : at + n], np.int64)))
        at += n
    return out


def _ids(block: bytes) -> np.ndarray:
    if len(block) < HEAD.size:
        raise ValueError("a block is cut short")
    n, lanes, kinds, size, check = HEAD.unpack_from(block)
    if not n or lanes != _lanes(n) or not 0 < kinds <= DISTINCT:
        raise ValueError("a block's head is wrong")
    at = HEAD.size + size
    if len(block) < at + 2 * lanes:
        raise ValueError("a block is cut short")
    try:
        gaps = np.frombuffer(zlib.decompress(block[HEAD.size : at]), "<u4")
    except zlib.error as e:
        raise ValueError("a block's dictionary is damaged") from e
    lengths = np.frombuffer(block, "<u2", lanes, at).astype(np.int64)
    if len(gaps) != kinds or len(block) != at + 2 * lanes + 2 * int(lengths.sum()):
        raise ValueError("a block is cut short")
    d = _Decoder(n, lanes, kinds, lengths, np.frombuffer(block, "<u2", offset=at + 2 * lanes))
    ids = np.cumsum(gaps, dtype=np.int64)[d.at.T.reshape(-1)[:n]]
    if _checksum(block[HEAD.size :], ids) != check:
        raise ValueError("a block's checksum is wrong")
    return ids


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block."""
    return [_ids(b) for b in blocks]
