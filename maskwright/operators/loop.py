"""The multi-step task loop over step reports, as a batch fold and as streaming state.

Both use :func:`advance`, so a stream gives what the batch gives.  A task ends
with its first terminal step: done, blocked, declined, failed or cancelled, the
second ``none`` in a row, or the ``BUDGET``-th step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET, STALLED = 15, 2
TERMINAL = ("done", "blocked", "declined", "failed", "cancelled")


def stalls(steps: DataFrame, task: str = "task_id", step: str = "step", state: str = "state") -> DataFrame:
    """``steps`` with ``stalled``: the run of ``none`` states up to each step."""
    upto = Window.partitionBy(task).orderBy(step)
    island = F.sum((F.col(state) != "none").cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy(task, "__island").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("__island", island).withColumn("stalled", F.sum((F.col(state) == "none").cast("int")).over(within)).drop("__island")


def finished(steps: DataFrame, budget: int = BUDGET, task: str = "task_id", step: str = "step", state: str = "state") -> DataFrame:
    """One row a task: status, steps. Tasks that haven't ended are ``running``.

    Only a task's first ``budget`` steps can count, so the fold is short; they are
    picked by rank, before anything is gathered.
    """
    n = F.row_number().over(Window.partitionBy(task).orderBy(step))
    rows = steps.withColumn("n", n).where(F.col("n") <= budget)
    status = (
        F.when(F.col(state).isin(*TERMINAL), F.col(state))
        .when(F.col("stalled") >= STALLED, "no_progress")
        .when(F.col("n") >= budget, "budget_exhausted")
    )
    ends = stalls(rows, task, "n", state).withColumn("status", status)
    first = F.min(F.when(F.col("status").isNotNull(), F.struct("n", "status")))
    return ends.groupBy(task).agg(first.alias("end"), F.max("n").alias("seen")).select(task, F.coalesce("end.status", F.lit("running")).alias("status"), F.coalesce("end.n", "seen").cast("int").alias("steps"))


def advance(n: int, stalled: int, state: str, budget: int = BUDGET) -> tuple[int, int, str | None]:
    """One step: the new count, the new run of ``none``, and the status if the task ends."""
    n += 1
    stalled = stalled + 1 if state == "none" else 0
    if state in TERMINAL:
        return n, stalled, state
    if stalled >= STALLED:
        return n, stalled, "no_progress"
    return n, stalled, "budget_exhausted" if n >= budget else None


def recent(rows: DataFrame, limit: int, key: str, order: str) -> DataFrame:
    """The last ``limit`` rows of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__n", n).where(F.col("__n") <= limit).drop("__n")


def sent_ring(rows: DataFrame, limit: int = BUDGET, task: str = "task_id", order: str = "seq") -> DataFrame:
    """Payloads of the task that sent last, the last ``limit`` of them; rows of a task before another one's are gone."""
    last = rows.agg(F.max_by(task, order).alias("__task"))
    own = rows.join(F.broadcast(last), F.col(task) == F.col("__task")).drop("__task")
    return own.orderBy(F.desc(order)).limit(limit)


def history(steps: DataFrame, limit: int = BUDGET, task: str = "task_id", step: str = "step") -> DataFrame:
    """The first ``limit`` steps of a task as history rows, texts cut to 120 characters."""
    n = F.row_number().over(Window.partitionBy(task).orderBy(step))
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, 120).alias(c)
    return steps.withColumn("n", n).where(F.col("n") <= limit).select(task, "n", "action", "target_role", cut("outcome"), cut("page_ident"))
