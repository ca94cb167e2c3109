"""Toxicity by averaged subword-bag embeddings and a linear softmax.

A word is the bag of its own hash bucket and those of its character 3- to
5-grams, so a misspelling shares most of its vectors with the word it distorts.
Word vectors are averaged over a passage of about ``PASSAGE`` words and a linear
softmax gives the two classes.  Embeddings and softmax are trained together, by
Adagrad in numpy.  Labels belong to whole documents, so after some epochs on random passages each epoch trains on
the passage of a document that the current model finds most toxic (and on a
random one of a clean document); a document's score is that of its most toxic passage, calibrated on
documents that training left out.

The classifier is fitted on a bounded sample of labelled rows: of those with a
document of at most ``sample_bytes`` bytes the first ``sample``, by a hash of
the id, and of these as many as have ``total_bytes`` together.  Scoring covers
every whole text.  Because the model is linear, only one
number a bucket (``BUCKETS`` floats, 0.5 MB) is broadcast.

Scale: the sample is drawn from ids and lengths, so labels and documents meet
without their texts; scoring is one narrow pass.  Memory is that of a text and a
cache of ``WORDS`` words.

Defined cases: texts without a word, null ones too, score 0;
rows without label, or with a null one, aren't learnt from; with no labelled
row at all every score is 0; repeated rows are scored alike; null ids count as
empty text in the fold; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import filtered, fold, id_and_text

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
PASSAGE = 32
WORDS = 400_000
SAMPLE = 9000
SAMPLE_BYTES = 100_000
TOTAL_BYTES = 64 << 20
#: The first START epochs train on EARLY random passages of each document, as no passage is known to be the toxic one.
EPOCHS, START, EARLY, RATE = 14, 6, 6, 2.0
INIT = 0.02
THRESHOLD = 0.3
#: Lower-cases A-Z and turns other ASCII that isn't a letter or digit into a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def subwords(word: bytes) -> list[int]:
    """Buckets of a word and of its 3- to 5-grams of characters."""
    marked = f"<{word.decode('utf-8', 'replace')}>"
    grams = [marked[i : i + n].encode() for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(b"=" + word) % BUCKETS, *(zlib.crc32(g) % BUCKETS for g in grams)]


def passages(n: int) -> np.ndarray:
    """Starts of the passages of n words; the last takes a short rest."""
    starts = np.arange(0, max(n, 1), PASSAGE)
    return starts[:-1] if len(starts) > 1 and n - starts[-1] < PASSAGE // 2 else starts


class Model:
    """What scoring needs: the toxic-minus-clean logit of each bucket, the bias, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0, none: bool = False):
        self.weights, self.bias, self.scale, self.shift, self.none = weights, bias, scale, shift, none

    def logits(self, values: np.ndarray) -> float:
        """The largest passage logit from word values."""
        if not len(values):
            return self.bias
        starts = passages(len(values))
        sums = np.add.reduceat(values, starts)
        return float((sums / np.diff(np.append(starts, len(values)))).max()) + self.bias

    def score(self, logit: float) -> float:
        if self.none:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -60, 60))))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, float] = {}

    def __call__(self, text: bytes) -> float:
        found, known, w = words(text), self.known, self.model.weights
        if not found:
            return 0.0
        if len(known) > WORDS:
            known.clear()
        for x in set(found).difference(known):
            known[x] = float(w[subwords(x)].mean())
        return self.model.score(self.model.logits(np.fromiter(map(known.__getitem__, found), np.float64, len(found))))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on whole documents with one label each; the list of texts is emptied to spare memory."""
    if not texts:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, none=True)
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words(t)], np.int32) for t in texts]
    gathered, sizes = array("i"), array("i")
    for w in index:
        bag = subwords(w)
        gathered.extend(bag)
        sizes.append(len(bag))
    texts.clear()
    del index
    counts, flat = np.array(sizes, np.int32), np.array(gathered, np.int32)
    at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    del gathered, sizes
    y = np.array(labels, np.float32)
    aside = rng.random(len(docs)) < 0.2
    tokens = np.concatenate([*docs, np.empty(0, np.int32)])
    lengths = np.array([len(d) for d in docs])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    # All passages: start and end among the tokens, and their document.
    cuts = [np.append(passages(n), n) if n else () for n in lengths]
    spans = [(begin[i] + a, begin[i] + b, i) for i, c in enumerate(cuts) for a, b in zip(c[:-1], c[1:], strict=True)]
    lo, hi, own = (np.array(x, np.int64) for x in zip(*spans, strict=True)) if spans else (np.empty(0, np.int64),) * 3
    first = np.searchsorted(own, np.arange(len(docs)))
    last = np.searchsorted(own, np.arange(len(docs)), side="right")
    emb = rng.normal(0, INIT, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.array([0.0, np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))], np.float32)
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-9, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-1, np.float32)

    def passage_logits() -> np.ndarray:
        u = emb @ (out[:, 1] - out[:, 0])
        v = np.add.reduceat(u[flat], at[:-1]) / counts
        t = v[tokens].astype(np.float64)
        sums = np.concatenate([[0], np.cumsum(t)])
        return (sums[hi] - sums[lo]) / (hi - lo) + float(bias[1] - bias[0])

    usable = np.flatnonzero(~aside & (last > first))
    for epoch in range(epochs if len(usable) else 0):
        z = passage_logits()
        chosen = []
        for i in usable:
            if epoch >= START:
                chosen.append(first[i] + int(np.argmax(z[first[i] : last[i]])))
            for _ in range(EARLY if epoch < START else not y[i]):
                chosen.append(int(rng.integers(first[i], last[i])))
        order = rng.permutation(np.array(chosen))
        rate = RATE * (1 - epoch / epochs)
        for k in range(0, len(order), 256):
            seg = order[k : k + 256]
            size = hi[seg] - lo[seg]
            tok = tokens[np.concatenate([np.arange(a, b) for a, b in zip(lo[seg], hi[seg], strict=True)])]
            row = np.repeat(np.arange(len(seg)), size)
            n = counts[tok]
            sub = flat[np.repeat(at[tok] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            weight = np.repeat(1.0 / (n * size[row]), n).astype(np.float32)
            _, buckets, grad, d_out, d_bias = gradients(emb, out, bias, sub, np.repeat(row, n), weight, y[own[seg]].astype(int))
            g_emb[buckets] += (grad**2).mean(1)
            g_out += d_out**2
            g_bias += d_bias**2
            emb[buckets] -= rate * grad / np.sqrt(g_emb[buckets])[:, None]
            out -= rate * 0.2 * d_out / np.sqrt(g_out)
            bias -= rate * 0.2 * d_bias / np.sqrt(g_bias)
    z = passage_logits() if len(own) else np.empty(0)
    tops = np.array([z[first[i] : last[i]].max() if last[i] > first[i] else float(bias[1] - bias[0]) for i in range(len(docs))])
    held = aside if 5 <= y[aside].sum() < aside.sum() else np.ones(len(docs), bool)
    scale, shift = _calibrated(tops[held], y[held])
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), scale, shift)


def gradients(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, sub: np.ndarray, row: np.ndarray, weight: np.ndarray, target: np.ndarray):
    """Loss of some passages, a sixteenth of the sum of their cross entropies, and its gradients.

    Subword ``sub[i]`` counts ``weight[i]`` in passage ``row[i]`` (ascending).
    Returns the loss, the buckets that occur, and the gradients of their
    embeddings, of the softmax and of the bias.
    """
    edge = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
    h = np.add.reduceat(emb[sub] * weight[:, None], edge)
    logit = h @ out + bias
    logit -= logit.max(1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(1, keepdims=True)
    loss = -np.log(p[np.arange(len(p)), target]).sum() / 16
    p[np.arange(len(p)), target] -= 1
    g = p / 16
    back = g @ out.T
    buckets, inverse = np.unique(sub, return_inverse=True)
    grad = np.stack([np.bincount(inverse, weight * back[row, j], len(buckets)) for j in range(emb.shape[1])], 1).astype(emb.dtype)
    return loss, buckets, grad, h.T @ g, g.sum(0)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit of labels by logits, with a little shrinkage."""
    a, b = 1.0, 0.0
    spread, mid = float(z.std()) or 1.0, float(z.mean())
    x = (z - mid) / spread
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        a -= 0.5 * float(((p - y) * x).mean() + 1e-3 * a)
        b -= 0.5 * float((p - y).mean())
    a = max(a, 1e-3)
    return a / spread, b - a * mid / spread


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled rows of ``docs`` for whose ids ``use`` (over doc_id) holds."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    known = known.where(use) if use is not None else known
    rows = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64(F.col("text").cast("string")))
    sizes = rows.select("doc_id", "h", F.octet_length("text").alias("n")).where(F.col("n") <= sample_bytes)
    # Rows that repeat a document and its label are learnt from once.
    first = sizes.join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h", "toxic").limit(sample).collect()
    picked, total = [], 0
    for r in first:
        total += r["n"]
        if total > total_bytes:
            break
        picked.append((r["doc_id"], r["h"], r["toxic"]))
    few = docs.sparkSession.createDataFrame(picked, f"doc_id {dict(rows.dtypes)['doc_id']}, h long, toxic int")
    rows = rows.join(F.broadcast(few), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "toxic"]).orderBy(F.xxhash64("doc_id"), "doc_id", "h", "toxic").select("text", "toxic")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        if not texts:
            return
        m = train(texts, marks)
        yield pa.RecordBatch.from_pylist([{"weights": m.weights.tobytes(), "bias": m.bias, "scale": m.scale, "shift": m.shift, "none": m.none}])

    # The bounded sample is one task's work on an executor; the driver gets the weights only.
    m = rows.coalesce(1).mapInArrow(trained, "weights binary, bias double, scale double, shift double, none boolean").first()
    if m is None:  # not a row, and so not a task
        return train([], [])
    return Model(np.frombuffer(m["weights"], np.float32), m["bias"], m["scale"], m["shift"], m["none"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(x.as_py()) for x in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from ids whose crc32 mod 4 isn't 2."""
    model = fit(docs, labels, fold("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those scored at the threshold or above, all columns as they were; each row by its own text."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fold("doc_id", 4) != 2, id_col=id_col, text_col=text_col))

    def judge():
        of = Scorer(sent.value)
        return lambda texts: [of(x) < threshold for x in texts]

    return filtered(docs, judge, text_col)
