"""Runs a streaming operator over rows that are already there, trigger by trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.sources.readers import scratch


COMES = "__comes"
#: Tasks a core of the operators that hold state, at most: each opens, commits and cleans a store of its own at every trigger.
STORES = 2


def streamed(df: DataFrame, triggers: int = 3, order: str | None = None, end: DataFrame | None = None, delay: str | None = None) -> DataFrame:
    """``df`` as a stream of so many triggers, by ``order`` or dealt at random; then one of ``end``.

    Without an order a trigger takes a few files, so that writing them isn't the work of as few tasks as there are triggers.
    Rows dealt at random may be as late as the table is long.  With ``delay`` a row
    comes in its own place or up to so much later than others by ``ts``, so that a
    watermark of that delay loses none, however long the table is.
    """
    spark = df.sparkSession
    path, files = scratch(spark, "stream"), 1
    if order or delay:
        # Files are taken in the order in which they were written.
        rows = df.withColumn(COMES, F.col(order) if order else _comes(df, delay))
        cuts = rows.approxQuantile(COMES, [i / triggers for i in range(1, triggers)], 0.01)
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = rows if low is None else rows.where(F.col(COMES) > low)
            part = part if high is None else part.where(F.col(COMES) <= high)
            part = part.drop(COMES)
            (part.coalesce(1) if order else part.repartition(1)).write.mode("append").parquet(path)
    else:
        files = max(1, spark.sparkContext.defaultParallelism // triggers)
        # Dealing by a hash of the row saves the sort that dealing in turn needs to be repeatable.
        dealt = df.repartition(triggers) if files == 1 else df.repartition(triggers * files, F.xxhash64(*df.columns))
        dealt.write.parquet(path)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _comes(df: DataFrame, delay: str) -> Column:
    """When a row comes, in seconds: its ``ts`` and, by a hash of the row, a part of the delay. Rows without a time come first."""
    share = F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000)) / 1_000_000
    late = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {delay}")) / 1e6
    return F.coalesce(F.unix_micros("ts") / 1e6 + share * late, F.lit(0.0))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives until its source is empty, as a table."""
    spark = stream.sparkSession
    path, checkpoint = scratch(spark, "drained"), scratch(spark, "checkpoint")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    # A stream takes the session's setting as it starts, and keeps it.
    spark.conf.set(key, min(int(before), STORES * spark.sparkContext.defaultParallelism))
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def replayed(df: DataFrame, operator: Callable[[DataFrame], DataFrame], triggers: int = 3, order: str | None = None, end: DataFrame | None = None) -> DataFrame:
    return drained(operator(streamed(df, triggers, order, end)))


def end_of(df: DataFrame, **values) -> DataFrame:
    """One row of ``values`` (null for the other columns) a year behind the last event time ``ts``: it moves the watermark past all others."""
    last = df.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))
    return last.select(*[F.col("ts") if c.name == "ts" else F.lit(values.get(c.name)).cast(c.dataType).alias(c.name) for c in df.schema])
