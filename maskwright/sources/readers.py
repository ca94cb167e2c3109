"""Readers of records and dimensions, and the audit sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.redact import has_structured, pii_free
from maskwright.sources.scratch import persist, scratch

BOX = "array<int>"
SCREEN = f"""id string, type string, sourceUrl string, capturedAt string, annotatedAt string, viewport struct<width:int,height:int>,
documentHeight int, persona string, elements array<struct<oracleId:string,role:string,name:string,bbox:{BOX}>>,
pii array<struct<id:string,type:string,value:string,text:string,bbox:{BOX}>>, texts array<struct<text:string,truthId:string>>,
vision struct<faces:array<struct<id:string,source:string,bbox:{BOX}>>,pixelText:array<struct<id:string,text:string,bbox:{BOX},pii:struct<type:string,value:string>>>>"""
INDEX = "version string, annotatedAt string, screens int, piiSpans int, oracleElements int, rows array<struct<id:string,elements:int,pii:int>>"
REVIEW = "reviewedAt string, method string, distinctValues int, detections int, entries array<struct<type:string,value:string,count:int,screens:array<string>,verdict:string>>"
STAGES = ("observe", "decide", "reason", "confirm", "act", "error")


def screens(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Ground-truth screens of a folder of JSON files, without its two index files."""
    rows = spark.read.schema(SCREEN).option("multiLine", True).json(f"{folder}/{pattern}")
    return rows.where(~F.input_file_name().rlike("/(?:sources|index)\\.json$")).where(F.col("id").isNotNull())


def indexed_screens(spark: SparkSession, folder: str, index: str | None = None, pattern: str = "*.json") -> DataFrame:
    """The screens that the index names."""
    named = spark.read.schema(INDEX).option("multiLine", True).json(index or f"{folder}/index.json").select(F.explode("rows").alias("r")).select("r.id")
    return screens(spark, folder, pattern).join(named, "id", "left_semi")


def review(spark: SparkSession, path: str) -> DataFrame:
    """(type, value, count, verdict) of reviewed detections."""
    return spark.read.schema(REVIEW).option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.type", "e.value", "e.count", "e.verdict")


def page_file(spark: SparkSession, path: str) -> DataFrame:
    """Whole pages, gzipped or not: path, html."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of files, for pin checks."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def settings(lines: Column) -> Column:
    """``struct<key, value>`` of a KEY=VALUE line; null for comments and other lines. Quotes around a value are taken off."""
    bare = F.trim(lines)
    value = F.trim(F.substring(bare, F.instr(bare, "=") + 1, F.length(bare)))
    plain = F.regexp_replace(value, r"^([\"'])(.*)\1$", "$2")
    return F.when(~bare.startswith("#") & F.contains(bare, F.lit("=")), F.struct(F.trim(F.substring_index(bare, "=", 1)).alias("key"), plain.alias("value")))


AUDIT = "id string, ts timestamp, seq long, task_id string, stage string, detail string, ok boolean"


def append_audit(rows: DataFrame, path: str) -> None:
    """Append (task_id, stage, detail, ok) entries with an id, a time and a sequence; one writer at a time.

    An entry whose detail holds structured personal data fails the write.  The
    sequence goes on from the table's last number and follows the rows' order,
    with gaps, so that no task has to count the others.
    """
    spark = rows.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    last = spark.read.schema(AUDIT).parquet(path).agg(F.max("seq")).first()[0] if there else None
    checked = rows.withColumn("detail", pii_free(F.col("detail")))
    seq = F.monotonically_increasing_id() + (0 if last is None else last + 1)
    checked.select(F.uuid().alias("id"), F.current_timestamp().alias("ts"), seq.alias("seq"), F.col("task_id").cast("string").alias("task_id"), "stage", "detail", "ok").write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str, task_id: str | None = None) -> DataFrame:
    """Entries in their order, of one task or all."""
    rows = spark.read.schema(AUDIT).parquet(path)
    rows = rows if task_id is None else rows.where(F.col("task_id") == task_id)
    return rows.orderBy("seq")


def audit_stream(entries: DataFrame, path: str):
    """A writer that appends a stream's entries, trigger by trigger; each trigger's rows in the order of ``ord``, if there is one."""

    def append(batch: DataFrame, _: int) -> None:
        append_audit(batch.orderBy("ord") if "ord" in batch.columns else batch, path)

    return entries.writeStream.foreachBatch(append)


def audit_rejects(rows: DataFrame) -> DataFrame:
    """Entries that the audit log would refuse."""
    return rows.where(has_structured(F.col("detail")))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
