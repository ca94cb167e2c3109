"""Conflict-constrained best-fit packing of documents into training sequences.

A document of ``n`` words needs n + 1 places (one for the end token); longer
ones are cut into pieces of at most ``capacity``.  Pieces are taken from the
longest; open bins are ordered by residual and each bin carries a bitmap of its
documents' sources and one of their duplicate clusters.  The search starts at
the smallest residual that fits and goes on to its successors until the
tightest bin without a common bit is found; if there is none, a bin is opened.
So no bin holds two pieces of one source, or of one cluster.

Scale: documents are dealt by a hash of their id and place in the input into
shards of about ``SHARD`` rows, which are packed independently; only (id, length,
source, cluster) is shuffled.  A hot source, id or text is spread over all
shards alike.  A shard's bitmaps have one bit for each source or cluster that
occurs more than once in it.  The tightest bin is that of the shard, not of all
documents; what that costs is the last, half empty bins of each shard (README
gives the fill beside that of one shard).

Defined cases: null and empty texts need one place; null sources and null
clusters conflict with nothing; repeated rows are packed separately; ties are
broken by id, then by piece; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import WS

CAPACITY = 2048
#: Documents of one shard, about; bounds the search of a piece and a task's memory.
SHARD = 4096


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each (length, source bits, cluster bits), in the order given."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (sources[b] & source or clusters[b] & cluster):
                break
            at += 1
        if at < len(open_bins):
            room, b = open_bins.pop(at)
            sources[b] |= source
            clusters[b] |= cluster
        else:
            room, b = capacity, len(sources)
            sources.append(source)
            clusters.append(cluster)
        if room > size:
            insort(open_bins, (room - size, b))
        out.append(b)
    return out


def _bits(values: list) -> dict:
    """A bit for each value that can conflict."""
    often = [v for v, n in Counter(v for v in values if v is not None).items() if n > 1]
    return {v: 1 << i for i, v in enumerate(often)}


def _packed(capacity: int):
    def run(key, table):
        shard = key[0].as_py()
        ids, sizes, sources, clusters = (table[c].to_pylist() for c in ("doc_id", "size", "source", "cluster"))
        cut = [(min(capacity, n - start), i, start) for i, n in enumerate(sizes) for start in range(0, n, capacity)]
        cut.sort(key=lambda x: (-x[0], ids[x[1]] is None, ids[x[1]], x[2]) if ids[x[1]] is not None else (-x[0], True, 0, x[2]))
        source_bits, cluster_bits = _bits([sources[i] for _, i, _ in cut]), _bits([clusters[i] for _, i, _ in cut])
        bins = best_fit([(n, source_bits.get(sources[i], 0), cluster_bits.get(clusters[i], 0)) for n, i, _ in cut], capacity)
        fill = Counter()
        starts = []
        for (n, _, _), b in zip(cut, bins, strict=True):
            starts.append(fill[b])
            fill[b] += n
        return pa.table(
            [
                pa.array([ids[i] for _, i, _ in cut], table.schema.field("doc_id").type),
                pa.array([s // capacity for _, _, s in cut], pa.int64()),
                pa.array([s for _, _, s in cut], pa.int64()),
                pa.array([n for n, _, _ in cut], pa.int64()),
                pa.array([f"{shard}-{b}" for b in bins]),
                pa.array(starts, pa.int64()),
                pa.array([fill[b] for b in bins], pa.int64()),
                pa.array([sources[i] for _, i, _ in cut], pa.string()),
            ],
            ["doc_id", "piece", "piece_start", "n_tokens", "bin_id", "bin_start", "bin_fill", "source"],
        )

    return run


def words(text: str = "text") -> Column:
    """Words of a text column, by ASCII white space."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"^{WS}|{WS}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WS, -1))).cast("long")


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size: Column | None = None, source: Column | None = None, cluster: Column | None = None, shard_rows: int = SHARD) -> DataFrame:
    """One row a piece: doc_id, piece, piece_start, n_tokens, bin_id, bin_start, bin_fill, source.

    ``size``: places a document needs (by default its words and an end token);
    ``source`` and ``cluster``: what must not meet in a bin, as text.
    """
    size = words() + 1 if size is None else size
    source = F.col("source") if source is None else source
    cluster = F.lit(None) if cluster is None else cluster
    n = docs.count()
    shards = max(1, -(-n // shard_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), size.cast("long").alias("size"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    kind = dict(rows.dtypes)["doc_id"]
    # Files are read in the same order again if a task is lost, so a row's number is the same.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_packed(capacity), f"doc_id {kind}, piece long, piece_start long, n_tokens long, bin_id string, bin_start long, bin_fill long, source string")


def text_cluster(text: str = "text") -> Column:
    """Cluster of equal texts: the digest of a text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WS, " ").cast("binary"), 256)
