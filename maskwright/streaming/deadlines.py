"""Deadlines on streams: proposals to settle, vision passes, captures, and models that lie idle.

Times are event times; a deadline has passed once the watermark is behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Milliseconds after which a delivered proposal without a report is settled, a delivered request without a
# proposal fails, an undelivered one fails, a vision pass has timed out, and a model is let go.
SETTLE_MS, ANSWER_MS, DELIVER_MS, VISION_MS, IDLE_MS = 3_000, 120_000, 20_000, 15_000, 90_000


KINDS = ("sent", "delivered", "proposed", "proposed_here", "reported")
OUTCOMES = pa.array(["fail", "synthesize", "redeliver", "use_report"])
NEVER = 1 << 62
#: States that the steps of a stream share.
BUCKETS = 1024


def settled(events: DataFrame, time: str = "ts", delay: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """One row (step_id, outcome, waited) a step, from a stream of (step_id, event) with event times.

    Events are ``sent``, ``delivered``, ``proposed`` (an action that moves the
    page), ``proposed_here`` (one that doesn't) and ``reported``.  A report ends a
    step as ``use_report``.  Without one, a delivered proposal that moves the page
    is synthesized after SETTLE_MS, one that doesn't fails after ANSWER_MS, a
    delivered step without a proposal is delivered again after SETTLE_MS, and one
    that wasn't delivered fails after DELIVER_MS.  ``waited`` are the milliseconds
    from sending to the outcome's time.

    Steps share a state by the hash of their id, ``buckets`` in all, so that Python
    is called for each bucket that a trigger touches and not for each step.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        parts = [pa.ipc.open_stream(state.get[0]).read_all()] if state.exists else []
        if not state.hasTimedOut:
            parts += [_seen(batch) for batch in batches]
        steps = pa.concat_tables(parts).group_by("step_id", use_threads=False).aggregate([*[(k, "min") for k in KINDS], ("until", "max"), ("touched", "max")])
        at = {k: steps[f"{k}_min"].to_numpy() for k in KINDS}
        until, touched = steps["until_max"].to_numpy().copy(), steps["touched_max"].to_numpy() > 0
        begin = np.minimum.reduce(list(at.values()))
        cases = [at["delivered"] == NEVER, at["proposed"] < NEVER, at["proposed_here"] < NEVER]
        due = np.select(cases, [begin + DELIVER_MS, at["delivered"] + SETTLE_MS, at["delivered"] + ANSWER_MS], at["delivered"] + SETTLE_MS)
        outcome = np.select(cases, [0, 1, 0], 2)
        told = at["reported"] <= due
        due, outcome = np.where(told, at["reported"], due), np.where(told, 3, outcome)
        done = until > 0
        ends = ~done & (due <= passed)
        # A settled step is remembered for a while, so that events that come late don't open it again.
        until[ends | (done & touched)] = passed + ANSWER_MS
        kept = ~done | touched | (until >= passed)
        if kept.any():
            rest = pa.table({"step_id": steps["step_id"], **at, "until": until, "touched": np.zeros(len(until), "int8")}).filter(pa.array(kept))
            state.update((_packed(rest),))
            state.setTimeoutTimestamp(max(int(np.where(until > 0, until, due)[kept].min()), passed + 1))
        elif state.exists:
            state.remove()
        if ends.any():
            rows = pa.table({"step_id": steps["step_id"], "outcome": OUTCOMES.take(pa.array(outcome)), "waited": due - begin}).filter(pa.array(ends))
            yield pd.DataFrame({"steps": [_packed(rows)]})

    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event"))
    rows = events.withWatermark(time, delay).select(F.col("step_id").cast("string").alias("step_id"), F.coalesce(kind, F.lit(0)).cast("byte").alias("kind"), F.col(time), (F.unix_micros(time) / 1000).cast("long").alias("ms"))
    rows = rows.withColumn("bucket", F.pmod(F.hash("step_id"), F.lit(buckets)))
    # What a bucket settles at once leaves it as one value: rows would pass through pandas one object at a time.
    packs = rows.groupBy("bucket").applyInPandasWithState(run, "steps binary", "steps binary", "append", GroupStateTimeout.EventTimeTimeout)
    return packs.mapInArrow(_unpacked, "step_id string, outcome string, waited long")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column(0):
            yield from pa.ipc.open_stream(pack.as_buffer()).read_all().to_batches(max_chunksize=10_000)


def _seen(batch: pd.DataFrame) -> pa.Table:
    """The times of a batch's events in the form of the state: a column for each of KINDS, and ``until``, which is 0 until the step is settled."""
    batch = batch[batch["kind"] > 0]
    kind, ms = batch["kind"].to_numpy(), batch["ms"].to_numpy("int64")
    n = len(batch)
    at = {k: np.where(kind == i, ms, NEVER) for i, k in enumerate(KINDS, 1)}
    return pa.table({"step_id": pa.array(batch["step_id"], pa.string(), from_pandas=True), **at, "until": np.zeros(n, "int64"), "touched": np.ones(n, "int8")})


def _packed(steps: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    # Most times are NEVER, and a state is written anew with each trigger.
    with pa.ipc.new_stream(sink, steps.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(steps)
    return sink.getvalue().to_pybytes()


def vision_results(started: DataFrame, finished: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(step_id, result) of streams (step_id, ts) and (step_id, ts, ok): ok, failed, or timed_out after VISION_MS without a result."""
    a = started.withWatermark("ts", delay).select("step_id", F.col("ts").alias("began"))
    b = finished.withWatermark("ts", delay).select(F.col("step_id").alias("of"), F.col("ts").alias("ended"), "ok")
    limit = F.expr(f"INTERVAL {VISION_MS // 1000} SECONDS")
    both = a.join(b, (F.col("step_id") == F.col("of")) & (F.col("ended") >= F.col("began")) & (F.col("ended") < F.col("began") + limit), "left_outer")
    return both.select("step_id", F.when(F.col("of").isNull(), "timed_out").when(F.col("ok"), "ok").otherwise("failed").alias("result"))


def captured(attempts: DataFrame, delay: str = "10 seconds", window: str = "1 minute") -> DataFrame:
    """(capture_id, attempts, captured) of a stream (capture_id, attempt, error, ts): one that meets a quota is tried once more.

    Attempts after the second, and any after one that succeeded or failed for another reason, don't count.
    """
    rows = attempts.withWatermark("ts", delay).where("attempt <= 2")
    first = lambda c: F.max(F.when(F.col("attempt") == 1, F.col(c)))
    told = rows.groupBy("capture_id", F.window("ts", window)).agg(first("error").alias("one"), F.max(F.when((F.col("attempt") == 2) & F.col("error").isNull(), 1)).alias("two"))
    again = F.coalesce(F.col("one") == "quota", F.lit(False))
    return told.select("capture_id", F.when(again, 2).otherwise(1).alias("attempts"), F.when(again, F.col("two").isNotNull()).otherwise(F.col("one").isNull()).alias("captured"))


def idle_releases(uses: DataFrame, key: str, delay: str = "10 seconds") -> DataFrame:
    """(key, released): when a key's model is let go, IDLE_MS after its last use, from a stream of uses with event times."""
    # A window ends before its gap is over, so a use right at the end of it would open another one.
    gap = F.session_window("ts", f"{IDLE_MS // 1000} seconds 1 microsecond")
    spans = uses.withWatermark("ts", delay).groupBy(key, gap.alias("used")).agg(F.count("*").alias("uses"))
    return spans.select(key, (F.col("used.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("released"), "uses")
