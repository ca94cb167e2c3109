"""Contexts sent to a reasoning server, and its answers judged."""

from __future__ import annotations

import http.client
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import actions as A
from maskwright.functions import contract

TIMEOUT = 20.0


def _posted(url: str, timeout: float):
    where = urlsplit(url)
    kind = http.client.HTTPSConnection if where.scheme == "https" else http.client.HTTPConnection
    path = (where.path or "/") + (f"?{where.query}" if where.query else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = None
        for batch in batches:
            status, replies = [], []
            for body in batch.column(batch.num_columns - 1).to_pylist():
                got = None, None
                if body is not None:
                    try:
                        line = line or kind(where.hostname, where.port, timeout=timeout)
                        line.request("POST", path, body.encode(), {"Content-Type": "application/json"})
                        answer = line.getresponse()
                        got = answer.status, answer.read().decode("utf-8", "replace")
                    except (OSError, http.client.HTTPException):
                        line = None  # the next request opens another one
                status.append(got[0])
                replies.append(got[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(status, pa.int32()), pa.array(replies, pa.string())], [*batch.schema.names[:-1], "status", "reply"])

    return run


def replies(contexts: DataFrame, url: str, key: str = "id", payload: str = "payload", timeout: float = TIMEOUT) -> DataFrame:
    """(key, status, reply, code) of each context: ``code`` is null for a valid answer.

    A payload that breaks the contract isn't sent.  A server that can't be reached
    has no status.  One connection a task; a task that runs again sends again.
    """
    rows = contexts.select(key, payload).withColumn("valid", F.coalesce(contract.valid_context(F.col(payload)), F.lit(False)))
    sent = rows.select(key, "valid", F.when(F.col("valid"), F.col(payload)).alias("body"))
    kind = dict(rows.dtypes)[key]
    got = sent.mapInArrow(_posted(url, timeout), f"{key} {kind}, valid boolean, status int, reply string")
    return got.select(key, "status", "reply", A.reply_error(F.col("valid"), F.col("status"), F.coalesce(contract.valid_action(F.col("reply")), F.lit(False))).alias("code"))
