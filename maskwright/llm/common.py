"""What the corpus operators share: scratch tables, safe column selection, filters by text.

Long lineages are cut with Parquet tables in the folder that the cluster names
in ``spark.checkpoint.dir``; every executor and the driver can read it, so a
lost executor costs only its running tasks.  A session on one machine that names
none gets a temporary folder; one on a cluster is refused, as its executors
would write to folders of their own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every operator: space, tab, LF, VT, FF, CR.
WS = "[\\x20\\x09-\\x0D]+"

_ours: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _ours:
        _ours["dir"] = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, _ours["dir"], ignore_errors=True)
    return "file://" + _ours["dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A path for one table that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`persist` wrote and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Texts that pass between Spark and Python at once, in bytes; a batch of rows alone has no such bound.
BATCH_BYTES = 8 << 20


def lean(df: DataFrame) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless they are smaller."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the UTF-8 bytes of the text (null: empty).

    Other columns of ``docs``, whatever their names, never reach an operator.
    """
    lean(docs)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filtered(docs: DataFrame, judge: Callable[[], Callable[[list[bytes]], list[bool]]], text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is kept, in one narrow pass and with all columns as they were.

    ``judge`` is called once a task and gives the function that tells which of
    some texts (UTF-8 bytes, null as empty) stay.  Every row is judged by its own
    text, so null or repeated ids don't matter.
    """

    lean(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in batches:
            for start in range(0, len(batch), ROWS):  # few texts at a time are copied
                part = batch.slice(start, ROWS)
                texts = [x.as_py() or b"" for x in part.column(at).cast(pa.binary())]
                yield part.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Rows that :func:`filtered` looks at together.
ROWS = 512


def mark(text_col: str = "text") -> Column:
    """128 bits of a text (null: empty): with the id, they name a row well enough to find it again."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (id, mark) isn't in ``gone``, a table of two columns; nulls equal nulls."""
    return _met(docs, gone, id_col, text_col, "left_anti")


def once(docs: DataFrame, twice: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each (id, mark) of ``twice``, a table of two columns that few rows are in."""
    if twice.isEmpty():
        return docs
    some = _met(docs, twice, id_col, text_col, "left_semi")
    name = fresh(docs, "mark")
    some = some.withColumn(name, mark(text_col)).dropDuplicates([id_col, name]).drop(name)
    return without(docs, twice, id_col, text_col).unionByName(some)


def _met(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    names = fresh(docs, "key_id"), fresh(docs, "key_mark")
    keys = keys.toDF(*names)
    return docs.join(keys, docs[id_col].eqNullSafe(keys[names[0]]) & mark(text_col).eqNullSafe(keys[names[1]]), how)


#: Size of a bitmap of hashed keys: 1 MB.
BITS = 1 << 23


def bitmap(slots: DataFrame) -> np.ndarray:
    """BITS bools: which numbers (0 up to BITS, one column of ``slots``) occur.

    Words of 64 bits are or-ed on the executors, so at most BITS / 64 rows reach
    the driver however many keys there are.
    """
    slots = slots.toDF("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[np.asarray(words["word"])] = np.asarray(words["bits"])
    return np.unpackbits(out.astype("<i8").view(np.uint8), bitorder="little").astype(bool)
