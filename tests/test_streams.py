"""Streaming operators against brute force, with states, late events and long tables."""

import random
import uuid

from pyspark.sql import functions as F

from maskwright.catalog import QUERIES
from maskwright.streaming import deadlines, replay


def run(stream):
    """All rows of a stream, and the most rows that its states had."""
    name = f"t{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    return stream.sparkSession.table(name).collect(), max(states)


def settled_plainly(events):
    """(outcome, waited) by step, once all events are there."""
    steps = {}
    for step, event, ms in events:
        if event in deadlines.KINDS:
            at = steps.setdefault(step, {})
            at[event] = min(at.get(event, ms), ms)
    out = {}
    for step, at in steps.items():
        begin = min(at.values())
        if "delivered" not in at:
            outcome, due = "fail", begin + 20_000
        elif "proposed" in at:
            outcome, due = "synthesize", at["delivered"] + 3_000
        elif "proposed_here" in at:
            outcome, due = "fail", at["delivered"] + 120_000
        else:
            outcome, due = "redeliver", at["delivered"] + 3_000
        if at.get("reported", due + 1) <= due:
            outcome, due = "use_report", at["reported"]
        out[step] = (outcome, due - begin)
    return out


def test_settled_shares_states(spark):
    rng = random.Random(5)
    events = [(None if i == 0 else f"s{i}", kind, 1_700_000_000_000 + rng.choice([0, 50, 3_000, 20_000, 120_001]) + rng.randrange(9)) for i in range(600) for kind in rng.choices([*deadlines.KINDS, "unknown"], k=rng.randrange(1, 6))]
    rows = spark.createDataFrame(events, "step_id string, event string, ms long").select("step_id", "event", F.timestamp_millis("ms").alias("ts"))
    stream = replay.streamed(rows, end=replay.end_of(rows, step_id="end", event="sent"))
    got, states = run(deadlines.settled(stream, delay="1 hour", buckets=16))
    want = settled_plainly(events)
    assert len(got) == len(want)
    assert {r.step_id: (r.outcome, r.waited) for r in got} == want
    assert states <= 16  # one by step is 600, each of them a call of Python


def test_settled_ignores_late_events_of_settled_steps(spark):
    at = lambda *rows: [(s, e, 1_700_000_000_000 + ms) for s, e, ms in rows]
    events = at(("a", "sent", 0), ("a", "delivered", 50), ("b", "sent", 60_000), ("a", "reported", 61_000), ("c", "sent", 100_000), ("a", "reported", 101_000), ("c", "delivered", 100_500), ("d", "sent", 900_000))
    rows = spark.createDataFrame([(*e, i) for i, e in enumerate(events)], "step_id string, event string, ms long, n int").select("step_id", "event", F.timestamp_millis("ms").alias("ts"), "n")
    stream = replay.streamed(rows, len(events), "n").drop("n")
    got, _ = run(deadlines.settled(stream, delay="1 second"))
    assert sorted(tuple(r) for r in got) == [("a", "redeliver", 3_050), ("b", "fail", 20_000), ("c", "redeliver", 3_500)]


def test_replay_within_a_delay_loses_nothing(spark):
    hours = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    rows = spark.range(600).select(F.col("id").alias("step_id"), hours.alias("ts"))  # ten hours, an hour's delay
    stream = replay.streamed(rows, end=replay.end_of(rows, step_id=-1), delay="1 hour").withWatermark("ts", "1 hour")
    query = stream.dropDuplicates(["step_id", "ts"]).writeStream.format("memory").queryName("within").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.step_id for r in spark.table("within").collect()) == list(range(-1, 600))
    assert sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators) == 0


def test_vision_timeouts_of_a_table_longer_than_the_delay(spark, tmp_path):
    """Event ids are milliseconds: these span nine hours."""
    spark.range(0, 33_000_000, 11_001).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.result for r in QUERIES["stream_vision_timeout"](spark, str(tmp_path)).collect()}
    result = lambda e: "timed_out" if e * 37 % 20_000 >= 15_000 or e % 13 == 0 else "failed" if e % 9 == 0 else "ok"
    assert got == {e: result(e) for e in range(0, 33_000_000, 11_001)}


def test_synthesized_proposals(spark, tmp_path):
    spark.range(3_000).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(r.id for r in QUERIES["stream_synthesize"](spark, str(tmp_path)).collect())
    assert got == [i for i in range(3_000) if i % 4 and i % 3 == 1 and (i % 5 == 0 or i * 37 % 5_000 > 2_800)]


def test_states_are_in_few_stores(spark, tmp_path, monkeypatch):
    """Each store costs a task and a commit at every trigger, however few rows there are; the session's setting is left as it was."""
    spark.range(3_000).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(replay, "scratch", lambda _, name: f"file://{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        got = QUERIES["stream_settle"](spark, str(tmp_path)).count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [p for p in (tmp_path / "checkpoint/state/0").iterdir() if p.name.isdigit()]
    assert got == 3_000 and len(stores) <= replay.STORES * spark.sparkContext.defaultParallelism


def test_triggers_of_several_files_lose_nothing(spark, tmp_path, monkeypatch):
    rows = spark.range(10_000).select(F.col("id").alias("step_id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    monkeypatch.setattr(replay, "scratch", lambda _, name: f"file://{tmp_path}/{name}")
    stream = replay.streamed(rows, 2, end=replay.end_of(rows, step_id=-1))
    assert len(list((tmp_path / "stream").glob("part-*"))) == 5  # two a trigger on four cores, and the end
    query = stream.writeStream.format("memory").queryName("several").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.step_id for r in spark.table("several").collect()) == list(range(-1, 10_000))
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows][2:] == [1]  # the end is a trigger of its own
