"""The task loop on a stream of step reports, with state by task.

Reports may come in any order.  They wait in the state until the watermark has
passed them, and are then taken in the order of their steps, each step once, so
the stream gives what the batch fold gives.  A task that has ended keeps a mark
for as long as ``forget``, during which late reports are ignored; then its state
is freed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskwright.operators.loop import BUDGET, advance

OUT = "task_id string, status string, steps int"
STATE = "n int, stalled int, status string, last long, steps array<long>, times array<long>, states array<string>"


def task_loop(steps: DataFrame, time: str = "ts", delay: str = "10 minutes", forget: str = "1 day", budget: int = BUDGET) -> DataFrame:
    """A row for each task as it ends, from a stream of (task_id, step, state) with event times.

    A report older than the watermark is late: it counts only if its step is
    still to come.  Repeats of a step are dropped.  State is three numbers a task
    and the reports that wait.
    """
    kept = int(pd.Timedelta(forget).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, stalled, status, last, *waiting = state.get if state.exists else (0, 0, "", -(1 << 62), [], [], [])
        if state.hasTimedOut and (status or not waiting[0]):  # over, or nothing heard for long
            state.remove()
            return
        reports = {s: (t, x) for s, t, x in zip(*waiting, strict=True)}
        if not status:
            for batch in batches:
                for s, t, x in zip(batch["step"], batch["ms"], batch["state"], strict=True):
                    if s > last and (s not in reports or (t, x) < reports[s]):
                        reports[int(s)] = (int(t), x)
        passed = state.getCurrentWatermarkMs()
        ended = None
        # A step waits for those before it: it is taken when all that could precede it have passed.
        ready = sorted(s for s, (t, _) in reports.items() if t <= passed)
        for s in ready:
            if min(reports) != s:
                break
            t, x = reports.pop(s)
            last = s
            n, stalled, end = advance(n, stalled, x, budget)
            if end:
                status, ended, reports = end, t, {}
                break
        order = sorted(reports)
        state.update((n, stalled, status, last, order, [reports[s][0] for s in order], [reports[s][1] for s in order]))
        due = passed + kept if status else min((t for t, _ in reports.values()), default=passed + kept)
        state.setTimeoutTimestamp(max(due, passed + 1))
        if ended is not None:
            yield pd.DataFrame({"task_id": [key[0]], "status": [status], "steps": [n]})

    rows = steps.withWatermark(time, delay).select(F.col("task_id").cast("string").alias("task_id"), F.col("step").cast("long").alias("step"), "state", F.col(time), (F.unix_micros(time) / 1000).cast("long").alias("ms"))
    return rows.groupBy("task_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
