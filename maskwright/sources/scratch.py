"""Tables that an operator writes for itself, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ours: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which all executors share; a temporary one in local mode without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _ours:
            _ours.append(tempfile.mkdtemp(prefix="maskwright-"))
            atexit.register(shutil.rmtree, _ours[0], ignore_errors=True)
        shared = f"file://{_ours[0]}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str) -> DataFrame:
    """``df``, written in the shared folder: what is used more than once is computed once, and a lost executor loses none of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
