"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (each run of ASCII white space becomes one space) and cut
into chunks of ``CHUNK`` bytes.  A chunk's hash is the polynomial of its bytes
modulo two primes; hashes of neighbours combine by shifting the left one by the
right one's length, ``H(ab) = H(a) * r^len(b) + H(b)``, so all chunks of a huge
document are hashed in one matrix product and then folded pairwise, and
documents that arrive in pieces are combined by :func:`combine_pieces`.

Documents with equal (length, fingerprint) are candidates.  Their texts are cut
into chunks of ``COMPARE`` bytes, and of each place in a group the least and the
greatest chunk are found: the group is believed only if they are the same
everywhere.  Groups in which a comparison failed are regrouped on the texts
themselves.

Scale: one narrow pass makes about 150 bytes a document, and the grouping is a
pre-aggregated count.  The comparison passes over the texts once more; a bitmap
of the candidates' fingerprints lets most others go, and each task compares what
it holds itself, so of a group with a third of all rows a task shuffles one row a
chunk.  The groups are written before the documents join them, so that adaptive
execution can split such a group's partition.  All intermediate tables lie in
the shared folder.

Defined cases: null text counts as empty and all empty texts are one group; a
null id never wins over a non-null one; a group of null ids only is kept; repeated rows stay
separate rows of the result with the same ``keep_id``; an empty table gives an
empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import BITS, WS, bitmap, id_and_text, mark, once, persist, without

CHUNK = 4096
#: Bytes compared at once when equal fingerprints are verified.
COMPARE = 1 << 20
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_664_525_001)


def _powers() -> np.ndarray:
    out = np.empty((CHUNK, 2))
    for j, (p, r) in enumerate(zip(PRIMES, BASES, strict=True)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, j] = x
            x = x * r % p
    return out


#: Row i weighs byte i of a full chunk. Symbols are byte + 1 <= 256 and weights < 2^31, so a chunk's sum stays under 2^53: exact in doubles.
POWERS = _powers()


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """The fingerprint of two neighbouring pieces from theirs."""
    return tuple((a * pow(r, right_len, p) + b) % p for a, b, p, r in zip(left, right, PRIMES, BASES, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    """Polynomial fingerprint of bytes, chunk hashes in parallel, then folded pairwise."""
    n = len(data)
    symbols = np.frombuffer(data, np.uint8)
    if n <= CHUNK:
        sums = (symbols + 1.0) @ POWERS[CHUNK - n :]
        return int(sums[0]) % PRIMES[0], int(sums[1]) % PRIMES[1]
    head = n % CHUNK
    first = fingerprint(data[:head])
    body = symbols[head:].reshape(-1, CHUNK)
    hashes = np.concatenate([((body[i : i + 256] + 1.0) @ POWERS).astype(np.uint64) for i in range(0, len(body), 256)])
    out = []
    for j, (p, r) in enumerate(zip(PRIMES, BASES, strict=True)):
        level, shift = hashes[:, j] % np.uint64(p), pow(r, CHUNK, p)
        while len(level) > 1:
            if len(level) % 2:
                level = np.concatenate([np.zeros(1, np.uint64), level])
            level = (level[::2] * np.uint64(shift) + level[1::2]) % np.uint64(p)
            shift = shift * shift % p
        out.append(int(level[0]))
    return combine(first, tuple(out), n - head)


def combine_pieces(pieces: DataFrame, id_col: str, order_col: str, bytes_col: str) -> DataFrame:
    """Fingerprints of documents that are stored as several rows of bytes.

    Pieces are hashed in parallel, wherever they lie; only 32 bytes of each are
    gathered by document.  Returns (id, n_bytes, fp1, fp2).  Null pieces count
    as empty.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x or b"" for x in batch.column(2).to_pylist()]
            prints = [fingerprint(x) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in data], pa.int64()), pa.array([x[0] for x in prints], pa.int64()), pa.array([x[1] for x in prints], pa.int64())], ["k", "o", "n", "h1", "h2"])

    kinds = dict(pieces.dtypes)
    parts = pieces.select(F.col(id_col).alias("k"), F.col(order_col).alias("o"), F.col(bytes_col).cast("binary").alias("b")).mapInArrow(hashed, f"k {kinds[id_col]}, o {kinds[order_col]}, n long, h1 long, h2 long")
    ordered = F.sort_array(F.collect_list(F.struct("o", "n", "h1", "h2")))

    @F.udf("struct<n_bytes:long,fp1:long,fp2:long>")
    def folded(rows):
        total, value = 0, (0, 0)
        for x in rows:
            value, total = combine(value, (x["h1"], x["h2"]), x["n"]), total + x["n"]
        return total, *value

    return parts.groupBy("k").agg(folded(ordered).alias("f")).select(F.col("k").alias(id_col), "f.*")


def normalised(data: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    words = data.split()
    if not words:
        return b" " if data else b""
    out = b" ".join(words)
    if data[0] in b" \t\n\x0b\x0c\r":
        out = b" " + out
    return out + b" " if data[-1] in b" \t\n\x0b\x0c\r" else out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, one, two, sha = [], [], [], []
        for x in batch.column(1):
            text = normalised(x.as_py())
            a, b = fingerprint(text)
            size.append(len(text))
            one.append(a)
            two.append(b)
            sha.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "mark", *KEY, "text_sha256"])


KEY = ["n_bytes", "fp1", "fp2"]


def _groups(digests: DataFrame) -> DataFrame:
    return persist(digests.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")


def _with_groups(digests: DataFrame, groups: DataFrame) -> DataFrame:
    out = digests.join(groups, KEY, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", "mark", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _slot(n: int, one: int, two: int) -> int:
    return (n * 31 + one * 7 + two) % BITS


def _differing(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(KEY) of groups in which not all texts are the same."""
    wanted = rows.sparkSession.sparkContext.broadcast(np.packbits(bitmap(groups.select((F.col("n_bytes") * 31 + F.col("fp1") * 7 + F.col("fp2")) % BITS))).tobytes())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8))
        for batch in batches:
            out = []
            for x in batch.column(0):
                text = normalised(x.as_py())
                a, b = fingerprint(text)
                if bits[_slot(len(text), a, b)]:
                    out += [(len(text), a, b, at, text[at : at + COMPARE]) for at in range(0, len(text), COMPARE)]
            cut = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cut, (*[pa.int64()] * 4, pa.binary()), strict=True)], [*KEY, "at", "chunk"])

    cut = rows.select("text").mapInArrow(chunks, "n_bytes long, fp1 long, fp2 long, at long, chunk binary")
    return cut.groupBy(*KEY, "at").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest")).where("least != greatest").select(*KEY).distinct()


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, keep_id, group_size, kept, text_sha256."""
    rows = id_and_text(docs, id_col, text_col).withColumn("mark", mark())
    kind = dict(rows.dtypes)["doc_id"]
    digests = persist(rows.mapInArrow(_digest, f"doc_id {kind}, mark binary, n_bytes long, fp1 long, fp2 long, text_sha256 string"), "digests")
    groups = _groups(digests)
    differing = persist(_differing(rows, groups), "differing")
    if differing.isEmpty():
        return _with_groups(digests, groups)
    # A fingerprint collided: those groups, and only those, are formed on whole texts.
    sure = _with_groups(digests.join(differing, KEY, "left_anti"), groups)
    rest = digests.join(differing, KEY).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "text_sha256").distinct()
    rest = rows.join(rest, rows.doc_id.eqNullSafe(rest.d) & (rows.mark == rest.m)).select("doc_id", "mark", "text_sha256", F.regexp_replace(F.col("text").cast("string"), WS, " ").alias("norm"))
    by_text = persist(rest.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    again = rest.join(by_text, "norm").select("doc_id", "mark", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return sure.unionByName(again)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(docs, id_col, text_col).drop("mark")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows are told apart by id and text, so an id's other texts are safe.  Of rows
    of one group with the same id, or none, one stays.
    """
    judged = persist(_judged(docs, id_col, text_col), "judged")
    several = judged.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.min("mark").alias("one")).where("n > 1")
    several = persist(several.select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("sha"), "one"), "several")
    others = judged.where("kept").join(several, judged.doc_id.eqNullSafe(several.d) & (judged.text_sha256 == several.sha))
    gone = judged.where("NOT kept").select("doc_id", "mark").unionByName(others.where("mark != one").select("doc_id", "mark")).distinct()
    return once(without(docs, persist(gone, "gone"), id_col, text_col), several.select("d", "one"), id_col, text_col)
