"""Queries on streams: each replays a table trigger by trigger, in no order, through an operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import redact as R
from maskwright.plans.act import _LOOP, _S
from maskwright.plans.inputs import PERSONA, STEPS, duck, sql, table
from maskwright.sources import readers
from maskwright.streaming import deadlines, replay
from maskwright.streaming.task_loop import task_loop

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _reports(spark, sf_dir):
    rows = sql(spark, sf_dir, STEPS).select(F.col("task_id").cast("string").alias("task_id"), F.col("step").cast("long").alias("step"), "state")
    return rows.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("step") * 60))


def _loop(rows):
    """Reports of 20 minutes, on a watermark an hour behind, in an order that isn't theirs."""
    end = replay.end_of(rows, task_id="end", step=1, state="executed")
    return replay.replayed(rows, lambda s: task_loop(s, delay="1 hour"), end=end).select(F.col("task_id").cast("long").alias("task_id"), "status", "steps")


@query("stream_task_loop", f"SELECT * FROM ({_LOOP}) AS l WHERE status <> 'running'")
def stream_task_loop(spark, sf_dir):
    """A row for each task that ends."""
    return _loop(_reports(spark, sf_dir))


@query("stream_cancel", f"SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'cancelled' ELSE status END AS status FROM ({_LOOP}) AS l WHERE status <> 'running' OR task_id % 3 = 0")
def stream_cancel(spark, sf_dir):
    """A control event in the same stream, before the first step, ends a task."""
    rows = _reports(spark, sf_dir)
    control = rows.select("task_id").distinct().where("task_id % 3 = 0").select("task_id", F.lit(0).cast("long").alias("step"), F.lit("cancelled").alias("state"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    return _loop(rows.unionByName(control)).select("task_id", "status")


#: Events of a step, in milliseconds after it was sent: delivered, proposed (moving the page or not), reported.
_STEP = "SELECT event_id AS id, event_id % 4 <> 0 AS delivered, event_id % 3 AS kind, event_id * 37 % 5000 AS reported, event_id % 5 <> 0 AS reports FROM {events}"
_EVENTS = """SELECT id, 'sent' AS event, 0 AS ms FROM t UNION ALL SELECT id, 'delivered' AS event, 50 AS ms FROM t WHERE delivered
    UNION ALL SELECT id, CASE kind WHEN 1 THEN 'proposed' ELSE 'proposed_here' END AS event, 200 AS ms FROM t WHERE delivered AND kind > 0
    UNION ALL SELECT id, 'reported' AS event, 250 + reported AS ms FROM t WHERE delivered AND kind > 0 AND reports"""


@query("stream_settle", f"""SELECT id, CASE WHEN NOT delivered THEN 'fail' WHEN kind = 0 THEN 'redeliver' WHEN reports AND 250 + reported <= (CASE kind WHEN 1 THEN 3050 ELSE 120050 END) THEN 'use_report' WHEN kind = 1 THEN 'synthesize' ELSE 'fail' END AS outcome,
    CAST(CASE WHEN NOT delivered THEN 20000 WHEN kind = 0 THEN 3050 WHEN reports AND 250 + reported <= (CASE kind WHEN 1 THEN 3050 ELSE 120050 END) THEN 250 + reported WHEN kind = 1 THEN 3050 ELSE 120050 END AS BIGINT) AS waited FROM {duck(_STEP)} AS t""")
def stream_settle(spark, sf_dir):
    """What becomes of each proposal, by its events and the deadlines."""
    return _settled(spark, sf_dir)


def _settled(spark, sf_dir, where="true"):
    rows = spark.sql(_EVENTS.replace("FROM t", "FROM {t}"), t=sql(spark, sf_dir, _STEP))
    rows = rows.select(F.col("id").cast("string").alias("step_id"), "event", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("ms")).alias("ts"))
    out = replay.replayed(rows, lambda s: deadlines.settled(s, delay="1 hour").where(where), end=replay.end_of(rows, step_id="end", event="sent"))
    return out.select(F.col("step_id").cast("long").alias("id"), "outcome", "waited")


@query("stream_synthesize", f"SELECT id FROM {duck(_STEP)} AS t WHERE delivered AND kind = 1 AND NOT (reports AND 250 + reported <= 3050)")
def stream_synthesize(spark, sf_dir):
    """Proposals that moved the page and for which no report came in time."""
    return _settled(spark, sf_dir, "outcome = 'synthesize'").select("id")


@query("stream_vision_timeout", "SELECT event_id, CASE WHEN event_id * 37 % 20000 >= 15000 OR event_id % 13 = 0 THEN 'timed_out' WHEN event_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS result FROM events")
def stream_vision_timeout(spark, sf_dir):
    """A vision pass of 15 seconds or more, one that never ends, and one that fails degrade the step and say so."""
    e = F.col("event_id")
    base = F.lit(1_700_000_000_000) + e
    rows = table(spark, sf_dir, "events").select(e.alias("step_id"), F.timestamp_millis(base).alias("began"), F.timestamp_millis(base + e * 37 % 20000).alias("ended"), (e % 9 != 0).alias("ok"))
    # A pass that never ends has no result.
    began = rows.select("step_id", F.col("began").alias("ts"))
    ended = rows.where("step_id % 13 <> 0").select("step_id", F.col("ended").alias("ts"), "ok")
    # Steps begin a millisecond apart, so a long table is longer than the delay.
    streams = replay.streamed(began, end=replay.end_of(began, step_id=-1), delay="1 hour"), replay.streamed(ended, end=replay.end_of(ended, step_id=-2), delay="1 hour")
    out = replay.drained(deadlines.vision_results(*streams, "1 hour"))
    return out.where("step_id >= 0").select(F.col("step_id").alias("event_id"), "result")


@query("stream_capture_retry", "SELECT event_id, CAST(CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 2 END AS INT) AS attempts, event_id % 12 <> 0 AND event_id % 7 <> 1 AS captured FROM events WHERE event_id % 4 = 0 OR event_id % 7 <> 1 OR true".replace("event_id % 12 <> 0 AND event_id % 7 <> 1", "CASE WHEN event_id % 4 = 0 THEN event_id % 12 <> 0 ELSE event_id % 7 <> 1 END").replace(" WHERE event_id % 4 = 0 OR event_id % 7 <> 1 OR true", ""))
def stream_capture_retry(spark, sf_dir):
    """A capture that meets a quota is tried once more; other errors are final."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e.alias("capture_id"), F.timestamp_millis(F.lit(1_700_000_000_000) + e % 1000).alias("ts"))
    one = rows.withColumn("attempt", F.lit(1)).withColumn("error", F.when(F.col("capture_id") % 4 == 0, "quota").when(F.col("capture_id") % 7 == 1, "closed"))
    two = rows.where("capture_id % 4 = 0").withColumn("attempt", F.lit(2)).withColumn("error", F.when(F.col("capture_id") % 12 == 0, "quota"))
    rows = one.unionByName(two)
    return replay.replayed(rows, lambda s: deadlines.captured(s, "1 hour"), end=replay.end_of(rows, capture_id=-1, attempt=1)).where("capture_id >= 0").select(F.col("capture_id").alias("event_id"), "attempts", "captured")


@query("stream_idle_release", "SELECT user_id, count(*) AS releases, CAST(sum(n) AS BIGINT) AS uses FROM (SELECT user_id, grp, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 90 SECOND THEN 0 ELSE 1 END AS fresh FROM events) AS a) AS b GROUP BY user_id, grp) AS c GROUP BY user_id")
def stream_idle_release(spark, sf_dir):
    """How often a user's model is let go, after 90 seconds without use, and its uses."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    spans = replay.replayed(rows, lambda s: deadlines.idle_releases(s, "user_id", "180 days"), end=replay.end_of(rows, user_id=-1))
    return spans.where("user_id >= 0").groupBy("user_id").agg(F.count("*").alias("releases"), F.sum("uses").alias("uses"))


@query("stream_out_of_band", f"SELECT s.task_id, s.step, coalesce(r.outcome, 'lost') AS outcome FROM (SELECT task_id, step FROM {_S}) AS s LEFT JOIN (SELECT task_id, step, 'reported' AS outcome FROM {_S} WHERE step % 3 = 0) AS r ON s.task_id = r.task_id AND s.step = r.step")
def stream_out_of_band(spark, sf_dir):
    """Reports that come outside the channel join their steps, stream to stream, within an hour."""
    rows = _reports(spark, sf_dir).select("task_id", "step", "ts")
    late = rows.where("step % 3 = 0").select("task_id", "step", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts"))
    a = replay.streamed(rows, end=replay.end_of(rows, task_id="end", step=1)).withWatermark("ts", "1 hour")
    b = replay.streamed(late, end=replay.end_of(late, task_id="end of reports", step=1)).withWatermark("ts", "1 hour").select(F.col("task_id").alias("t"), F.col("step").alias("s"), F.col("ts").alias("told"))
    met = a.join(b, F.expr("task_id = t AND step = s AND told >= ts AND told <= ts + INTERVAL 1 HOUR"), "left_outer")
    out = replay.drained(met.select("task_id", "step", F.when(F.col("t").isNotNull(), "reported").otherwise("lost").alias("outcome")))
    return out.where("NOT startswith(task_id, 'end')").select(F.col("task_id").cast("long").alias("task_id"), "step", "outcome")


# -- the audit log

_ACCEPTED = f"SELECT ord, scope_id, text FROM {duck(PERSONA)} AS p WHERE coalesce(type IN ('NAME', 'ADDRESS'), true)"


def _entries(spark, sf_dir):
    rows = sql(spark, sf_dir, PERSONA).where(~R.has_structured(F.col("text")))
    return rows.select("ord", F.col("scope_id").cast("string").alias("task_id"), F.lit("act").alias("stage"), F.col("text").alias("detail"), F.lit(True).alias("ok"))


def _numbered(rows, *by):
    from pyspark.sql.window import Window

    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("seq")))


@query("sink_audit", f"SELECT CAST(scope_id AS VARCHAR) AS task_id, text AS detail, row_number() OVER (PARTITION BY scope_id ORDER BY ord % 2, ord) AS n FROM ({_ACCEPTED}) AS a")
def sink_audit(spark, sf_dir):
    """Entries that the log accepts, appended in two batches and read in their order."""
    path = readers.scratch(spark, "audit")
    rows = readers.persist(_entries(spark, sf_dir), "entries")
    for k in (0, 1):
        readers.append_audit(rows.where(F.col("ord") % 2 == k).orderBy("ord"), path)
    return _numbered(readers.read_audit(spark, path), "task_id").select("task_id", "detail", "n")


@query("scan_audit", "SELECT CAST(user_id AS VARCHAR) AS task_id, event_type AS stage, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def scan_audit(spark, sf_dir):
    """The written log, read again task by task in the order of its entries."""
    path = readers.scratch(spark, "audit")
    rows = table(spark, sf_dir, "events").orderBy("event_id").select(F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("stage"), F.lit("ok").alias("detail"), F.lit(True).alias("ok"))
    readers.append_audit(rows, path)
    return _numbered(readers.read_audit(spark, path), "task_id").select("task_id", "stage", "n")


@query("stream_audit", f"SELECT CAST(scope_id AS VARCHAR) AS task_id, text AS detail, row_number() OVER (PARTITION BY scope_id ORDER BY ord) AS n FROM ({_ACCEPTED}) AS a")
def stream_audit(spark, sf_dir):
    """A stream of entries, appended trigger by trigger."""
    path = readers.scratch(spark, "audit")
    stream = replay.streamed(_entries(spark, sf_dir), 3, "ord")
    readers.audit_stream(stream, path).option("checkpointLocation", readers.scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return _numbered(readers.read_audit(spark, path), "task_id").select("task_id", "detail", "n")
