"""Token ids in compressed binary files, written and read back.

Texts are encoded by a public tokenizer, an end id follows each, and the ids, in
ascending order of the documents, are cut into segments whose ids the
context-mixing coder (:mod:`maskwright.llm.mixing_coder`) turns into blocks.
Blocks are reset and checksummed on their own.

A store is a folder of files, one a partition of the documents.  A file is

    MAGIC, segments, index, footer

* segment: bytes of its directory (4), number of blocks (4), each block's bytes
  (4), the directory - an Arrow stream of (doc_id, n_tokens) -, the blocks;
* index: offset, bytes and ids of each segment (8 each);
* footer: offset of the index (8), number of segments (8), MAGIC.

So a reader finds any segment from the index and reads nothing else.  Files are
written under a name of the attempt and renamed when whole: a task that is lost
or run twice leaves the same file.  They go to ``spark.checkpoint.dir`` through
Arrow's file systems (local and mounted paths, HDFS, S3, GCS, ABFS).

Encoding splits a text where a blank precedes a character that isn't white
space, and where a line feed stands between two such characters: the byte-level
pre-tokenizer always starts a token there, so a stretch between two such places
is encoded once a worker and looked up afterwards: Arrow cuts a segment's texts
and finds its distinct stretches, and Python looks only those up.  New stretches
of printable ASCII and Latin letters go to the tokenizer's model piece by piece.

Scale: one range shuffle by id and text, then narrow passes.  Reading deals out
segments, not files.  A document's start is its partition's start, added up from
one number a partition, plus its place in the partition.  Memory is that of a
segment of ``SEGMENT_BYTES`` of text, or one text, and of one block.

Defined cases: null and empty texts are just the end id; null ids come first;
repeated rows are stored again, in the order of their texts' hashes; an empty
table gives a store without files; other columns are not read.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.llm import mixing_coder
from maskwright.llm.common import persist, scratch

END_ID = 2
SEGMENT_BYTES = 4 << 20
#: Distinct stretches of text, and of their pieces, whose ids a worker remembers.
STRETCHES, PIECES = 500_000, 1_000_000
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Stretches of printable ASCII and Latin letters, without a start of a special token: their pieces are known from the pattern below.
PLAIN = re.compile(f"[ \n]?[!-;=-~{_LETTERS}]+").fullmatch
# Fixed value: the byte-level pre-tokenizer's pattern, for such stretches.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\n").findall
# Fixed value: the character that the byte-level pre-tokenizer writes for each byte.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
#: White space behind a blank or line feed, or at the end; then only a blank before a character is a place to cut.
ODD = re.compile(r"[ \n](?=\s)|[ \n]$")
#: The same for Arrow, whose \s is ASCII's; and APART.
ODD_BYTES = "[ \n][\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n]$|\x01"
CUT = re.compile(r"(?= \S)")
#: Marks that are a piece of their own between a word and the end of a stretch.
MARKS, BLANK = frozenset(",.;:!?)"), chr(BYTES[0x20])
#: Those that are cut off as stretches of their own, under names that begin with APART, in texts where each stands behind a letter
#: and before a blank, a line feed or the end.
STOPS, APART = ",.", "\x01"
JOINED = f"(?:^|[^{_LETTERS}])[{STOPS}]|[{STOPS}][^ \n]"
MAGIC = b"MWTOKENS"
ENTRY, FOOTER = struct.Struct("<QQQ"), struct.Struct("<QQ8s")


class _Known(dict):
    """Ids of stretches by their names, as bytes; one that is asked for first is encoded."""

    def __init__(self, encode: Callable[[str | tuple[str]], bytes]):
        self.encode = encode

    def __missing__(self, name) -> bytes:
        got = self[name] = self.encode(name)
        return got


class Encoder:
    """Ids of texts as the tokenizer itself gives them, with a memory of stretches."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), struct.pack("<I", end_id)
        self.tokenize = self.tokenizer.model.tokenize
        #: Ids of pieces, as bytes.
        self.pieces: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.known = _Known(self._encoded)
        # What is before a text's first blank, if it begins with one.
        self.known[""] = self.known["",] = b""

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            # What the pre-tokenizer would hand over.
            shown = piece.replace(" ", BLANK) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTES)
            got = self.pieces[piece] = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        return got

    def _encoded(self, name: str | tuple[str]) -> bytes:
        # Most are a word, or a word and a mark.
        if type(name) is str:
            word = name if name.isalpha() else name[:-1] if name[-1] in MARKS and name[:-1].isalpha() else ""
            if word and (word.isascii() or max(word) < "\u0250"):
                got = self._piece(" " + word)
                return got if word is name else got + self._piece(name[-1])
            if name[0] == APART:
                return self._piece(name[1:])
        stretch = self.stretch(name)
        if PLAIN(stretch):
            return b"".join(map(self._piece, PIECE(stretch)))
        return self._plainly(stretch)

    def _plainly(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _odd(self, text: str) -> bytes:
        return self._plainly(text) if APART in text else b"".join(map(self.known.__getitem__, self.stretches(text)))

    @staticmethod
    def stretches(text: str) -> list:
        """Names of a text's stretches: what follows their blank, all if it is a line feed, and the first in a tuple."""
        if ODD.search(text):
            first, *rest = CUT.split(text)
            names = [None, *[x[1:] for x in rest]]
        else:
            names = text.replace("\n", " \n").split(" ")
            first = names[0]
        if not first:
            return names[1:]
        names[0] = (first,)
        return names

    @staticmethod
    def stretch(name: str | tuple[str]) -> str:
        return name[0] if isinstance(name, tuple) else name if name[0] == "\n" else " " + name

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts behind one another, each text's with the end id, and their numbers."""
        if not texts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.known) > STRETCHES:
            self.forget()
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, ODD_BYTES)
        # The same cuts as stretches() makes, for all texts at once; an odd one is a single stretch here.
        column = pc.if_else(odd, "", column)
        apart = column
        for mark in STOPS:
            apart = pc.replace_substring(apart, mark, f" {APART}{mark}")
        column = pc.if_else(pc.match_substring_regex(column, JOINED), column, apart)
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        first = lists.values.take(pa.array(offsets[:-1])).to_pylist()
        is_first = np.zeros(len(lists.values), bool)
        is_first[offsets[:-1]] = True
        names = pc.if_else(pa.array(is_first), pa.scalar(None, pa.large_string()), lists.values).dictionary_encode()
        entries = list(map(self.known.__getitem__, names.dictionary.to_numpy(zero_copy_only=False).tolist()))
        number = names.indices.fill_null(0).to_numpy().astype(np.int64)
        number[offsets[:-1]] = len(entries) + np.arange(len(texts))
        for text, name, is_odd in zip(texts, first, odd.to_pylist(), strict=True):
            entries.append(self._odd(text) if is_odd else self.known[name,])
        number = np.insert(number, offsets[1:], len(entries))
        entries.append(self.end)
        taken = pa.array(entries, pa.large_binary()).take(pa.array(number))
        stop = np.frombuffer(taken.buffers()[1], np.int64, len(number) + 1) // 4
        ids = np.frombuffer(taken.buffers()[2], np.uint32, int(stop[-1])).astype(np.int64)
        return ids, np.diff(stop[offsets[1:] + 1 + np.arange(len(texts))], prepend=0)


@cache
def _encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this worker, which goes on with what earlier tasks have met."""
    return Encoder(path, end_id)


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _segment(names: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = mixing_coder.encode(ids)
    batch = pa.RecordBatch.from_arrays([names, pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    directory = sink.getvalue()
    return b"".join([struct.pack(f"<II{len(blocks)}I", len(directory), len(blocks), *map(len, blocks)), directory, *blocks])


def _opened(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names, numbers of ids, and ids of a segment."""
    size, n = struct.unpack_from("<II", data)
    if 8 + 4 * n + size > len(data):
        raise ValueError("a segment is cut short")
    lengths = struct.unpack_from(f"<{n}I", data, 8)
    at = 8 + 4 * n
    table = pa.ipc.open_stream(data[at : at + size]).read_all()
    at += size
    blocks = []
    for x in lengths:
        blocks.append(data[at : at + x])
        at += x
    ids = np.concatenate([*mixing_coder.decode(blocks), np.empty(0, np.int64)])
    sizes = np.asarray(table["n_tokens"])
    if at != len(data) or len(ids) != sizes.sum():
        raise ValueError("a segment's ids don't fit its documents")
    return table["doc_id"].combine_chunks(), sizes, ids


class FileWriter:
    """One file of segments; nothing is seen under its name before it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = _file_system(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.out = self.fs.open_output_stream(self.draft, compression=None)
        self.out.write(MAGIC)
        self.at, self.index = len(MAGIC), []

    def add(self, names: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> tuple[int, int, int]:
        """Offset, bytes and ids of the new segment."""
        data = _segment(names, sizes, ids)
        self.out.write(data)
        self.index.append((self.at, len(data), len(ids)))
        self.at += len(data)
        return self.index[-1]

    def close(self) -> None:
        self.out.write(b"".join(ENTRY.pack(*x) for x in self.index) + FOOTER.pack(self.at, len(self.index), MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.path)


def read_index(path: str) -> list[tuple[int, int, int]]:
    """Offset, bytes and ids of each segment of a file, from its end."""
    fs, path = _file_system(path)
    with fs.open_input_file(path) as f:
        size = f.size()
        if size < len(MAGIC) + FOOTER.size or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token file")
        at, n, magic = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or at + n * ENTRY.size + FOOTER.size != size:
            raise ValueError("not a whole token file")
        return list(ENTRY.iter_unpack(f.read_at(n * ENTRY.size, at)))


def read_segment(path: str, offset: int, size: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and the ids of one segment; only its bytes are read."""
    fs, path = _file_system(path)
    with fs.open_input_file(path) as f:
        return _opened(f.read_at(size, offset))


def _written(path: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), _encoder(path, end_id)
        name, out = f"{folder}/part-{part:06d}.tokens", None
        names, texts, size = [], [], 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal out, names, texts, size
            ids, sizes = encode(texts)
            out = out or FileWriter(name)
            rows.append((part, len(rows), name, len(sizes), *out.add(pa.concat_arrays(names), sizes, ids)))
            names, texts, size = [], [], 0

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                names.append(batch.column(0).slice(i, 1))
                texts.append(text.as_py() or "")
                size += len(texts[-1]) + 64
                if size >= SEGMENT_BYTES:
                    flush()
        if texts:
            flush()
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], ["part", "segment", "path", "n_docs", "offset", "bytes", "n_ids"])

    return run


def write(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files of ``docs`` in the shared folder; a row a segment: part, segment, path, n_docs, offset, bytes, n_ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # The text's hash parts rows that repeat an id, or have none.
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    folder = scratch(docs.sparkSession, "store")
    return persist(ordered.mapInArrow(_written(tokenizer_path, end_id, folder), "part int, segment int, path string, n_docs long, offset long, bytes long, n_ids long"), "segments")


def _read(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                names, sizes, ids = read_segment(r["path"], r["offset"], r["bytes"])
                stops = np.cumsum(sizes)
                at = np.concatenate([[0], 4 * stops])
                data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([names.cast(kind), pa.array(r["start"] + stops - sizes), pa.array(sizes), data.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read(store: DataFrame, kind: str = "bigint") -> DataFrame:
    """One row a document of the files that ``store`` lists: doc_id (of type ``kind``), start (ids of all documents before it), n_tokens, ids (little-endian 32-bit numbers)."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark = store.sparkSession
    # One number a partition of the documents.
    sums = store.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in sums:
        before.append((r["part"], total))
        total += r["n"]
    parts = spark.createDataFrame(before, "part int, part_start long")
    earlier = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = store.withColumn("within", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(parts, "part")
    segments = starts.select("path", "offset", "bytes", (F.col("part_start") + F.col("within")).alias("start"))
    # A segment is a task's work for seconds, so a task gets few of them.
    n = max(1, min(store.count(), 100_000))
    return segments.repartition(n, "start").mapInArrow(_read(to_arrow_type(_parse_datatype_string(kind))), f"doc_id {kind}, start long, n_tokens long, ids binary")


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the store, reads it back: doc_id, start, n_tokens, ids_crc32."""
    got = read(write(docs, tokenizer_path, end_id), dict(docs.dtypes)["doc_id"])
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
