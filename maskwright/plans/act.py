"""Queries of actions, risk, validation, the task loop and the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import actions as A
from maskwright.functions import contract
from maskwright.operators import context as C
from maskwright.operators import loop as L
from maskwright.plans.inputs import ACTIONS, STEPS, duck, sql, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None, also: tuple[str, ...] = ()):
    def add(f):
        for n in (name, *also):
            QUERIES[n] = f
            if oracle:
                ORACLE[n] = oracle
        return f

    return add


_A = f"{duck(ACTIONS)} AS a"


def proposals(spark, sf_dir):
    """Proposals with their parameters as a map without nulls."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"p_{k}").alias("value")) for k in ("text", "url", "reason", "top")]), lambda e: e["value"].isNotNull())
    return sql(spark, sf_dir, ACTIONS).withColumn("params", F.map_from_entries(entries))


_LOCAL = "CASE WHEN action IN ('none', 'done', 'blocked') THEN 'low' WHEN action = 'navigate' OR sensitive OR confidence < 0.5 THEN 'high' WHEN confidence < 0.75 THEN 'medium' ELSE 'low' END"
_RANK = "CASE {0} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query("local_risk", f"SELECT id, {_LOCAL} AS risk FROM {_A}")
def local_risk(spark, sf_dir):
    return proposals(spark, sf_dir).select("id", A.local_risk(F.col("action"), F.col("confidence"), F.col("sensitive")).alias("risk"))


_EFFECTIVE = f"SELECT id, CASE WHEN {_RANK.format('risk')} >= {_RANK.format(f'({_LOCAL})')} THEN risk ELSE {_LOCAL} END AS risk FROM {_A}"


@query("effective_risk", _EFFECTIVE, also=("max_risk",))
def effective_risk(spark, sf_dir):
    return proposals(spark, sf_dir).select("id", A.effective_risk(F.col("risk"), F.col("action"), F.col("confidence"), F.col("sensitive")).alias("risk"))


@query("requires_confirmation", f"SELECT id, risk <> 'low' AS confirm FROM ({_EFFECTIVE}) AS e")
def requires_confirmation(spark, sf_dir):
    return effective_risk(spark, sf_dir).select("id", A.requires_confirmation(F.col("risk")).alias("confirm"))


_MARKS = "('M1', 'M2', 'M4', 'M5', 'M7')"
_PROBLEM = f"""CASE WHEN action IN ('click', 'type') AND target_id IS NULL THEN 'a ' || action || ' needs a target_id'
    WHEN action IN ('click', 'type') AND target_id NOT IN {_MARKS} THEN 'target_id ''' || target_id || ''' is not one of the marks you were given'
    WHEN action = 'type' AND coalesce(p_text, '') = '' THEN 'a type action needs params.text' WHEN action = 'navigate' AND coalesce(p_url, '') = '' THEN 'a navigate action needs params.url'
    WHEN action = 'blocked' AND coalesce(p_reason, '') NOT IN ('bot_detection', 'login_required', 'cannot_proceed') THEN 'a blocked action needs params.reason, one of bot_detection, login_required, cannot_proceed' END"""


def _problem():
    return A.semantic_problem(F.col("action"), F.col("target_id"), F.col("params"), F.array(*map(F.lit, ("M1", "M2", "M4", "M5", "M7"))))


@query("flt_semantic_action", f"SELECT id, {_PROBLEM} AS problem FROM {_A}")
def flt_semantic_action(spark, sf_dir):
    return proposals(spark, sf_dir).select("id", _problem().alias("problem"))


@query("reason_model", f"SELECT k, coalesce((array_agg(action ORDER BY attempt) FILTER (problem IS NULL))[1], 'none') AS action FROM (SELECT CAST(floor(id / 2) AS BIGINT) AS k, id % 2 AS attempt, action, {_PROBLEM} AS problem FROM {_A}) AS t GROUP BY k")
def reason_model(spark, sf_dir):
    """Two attempts of each request; the first without a problem is the answer."""
    rows = proposals(spark, sf_dir).select(F.floor(F.col("id") / 2).alias("k"), (F.col("id") % 2).alias("attempt"), "action", _problem().alias("problem"))
    return C.first_valid(rows, "k").select("k", "action")


@query("reason_to_action", f"SELECT id, CASE WHEN action IN ('click', 'type') THEN target_id END AS target_id FROM {_A}")
def reason_to_action(spark, sf_dir):
    return proposals(spark, sf_dir).select("id", A.kept_target(F.col("action"), F.col("target_id")).alias("target_id"))


@query("reason_fallback", f"SELECT id, CASE WHEN id % 3 = 0 THEN action WHEN id % 3 = 1 THEN 'none' ELSE 'done' END AS action FROM {_A}")
def reason_fallback(spark, sf_dir):
    first = F.col("id") % 3 == 0, F.col("action")
    second = F.col("id") % 3 == 1, F.lit("none")
    return proposals(spark, sf_dir).select("id", C.first_available([first, second, (F.lit(True), F.lit("done"))]).alias("action"))


_TARGETED = "(target_id IS NOT NULL AND exists_)"
_STATUS = f"""CASE WHEN action = 'none' THEN 'skipped' WHEN action IN ('done', 'blocked') THEN action WHEN action = 'navigate' AND coalesce(p_url, '') = '' THEN 'failed' WHEN action IN ('navigate', 'scroll') THEN 'executed'
    WHEN NOT {_TARGETED} THEN 'failed' WHEN action = 'click' THEN 'executed' WHEN NOT is_field OR p_text IS NULL THEN 'failed' ELSE 'executed' END"""
_REASON = f"""CASE WHEN action = 'none' THEN 'no_action' WHEN action = 'done' THEN NULL WHEN action = 'blocked' THEN coalesce(p_reason, 'cannot_proceed') WHEN action = 'navigate' AND coalesce(p_url, '') = '' THEN 'missing_parameter' WHEN action IN ('navigate', 'scroll') THEN NULL
    WHEN NOT {_TARGETED} THEN 'stale_target' WHEN action = 'click' THEN NULL WHEN NOT is_field THEN 'unsupported_target' WHEN p_text IS NULL THEN 'missing_parameter' END"""


def _outcome():
    return A.outcome(F.col("action"), F.col("target_id"), F.col("params"), F.col("exists_"), F.col("is_field"))


@query("execute_action", f"SELECT id, {_STATUS} AS status, {_REASON} AS reason FROM {_A}")
def execute_action(spark, sf_dir):
    return proposals(spark, sf_dir).select("id", _outcome().alias("o")).select("id", "o.status", "o.reason")


@query("proj_step_state", f"SELECT id, CASE status WHEN 'skipped' THEN 'none' ELSE status END AS state, CASE status WHEN 'executed' THEN 'executed ' || action WHEN 'skipped' THEN 'no action proposed' WHEN 'done' THEN 'task reported done' WHEN 'blocked' THEN 'stopped: ' || reason ELSE 'failed' END AS outcome FROM (SELECT id, action, {_STATUS} AS status, {_REASON} AS reason FROM {_A}) AS t")
def proj_step_state(spark, sf_dir):
    rows = proposals(spark, sf_dir).withColumn("o", _outcome()).select("id", A.step_state(F.col("action"), F.col("o")).alias("s"))
    return rows.select("id", "s.state", F.when(F.col("s.state") == "failed", "failed").otherwise(F.col("s.outcome")).alias("outcome"))


@query("coerce_number", f"SELECT id, CASE WHEN p_top IS NULL THEN 0 WHEN p_top = 'far' THEN 'nan' ELSE CAST(p_top AS DOUBLE) END AS top FROM (SELECT id, p_top FROM {_A}) AS t".replace("THEN 0 WHEN p_top = 'far' THEN 'nan'", "THEN CAST(0 AS DOUBLE) WHEN p_top = 'far' THEN CAST(-1 AS DOUBLE)"))
def coerce_number(spark, sf_dir):
    """NaN, which engines compare differently, is shown as -1."""
    top = A.scroll_top(F.col("params"))
    return proposals(spark, sf_dir).select("id", F.when(F.isnan(top), -1.0).otherwise(top).alias("top"))


@query("proj_describe_action", f"SELECT id, CASE action WHEN 'click' THEN 'Click ' || coalesce(target_id, 'undefined') WHEN 'type' THEN 'Type into ' || coalesce(target_id, 'undefined') WHEN 'scroll' THEN 'Scroll the page by ' || coalesce(p_top, '0') || 'px' WHEN 'navigate' THEN 'Navigate to ' || coalesce(p_url, 'an unspecified URL') WHEN 'none' THEN 'Take no action' WHEN 'done' THEN 'Finish the task: completed' ELSE 'Stop: ' || coalesce(p_reason, 'cannot proceed') END AS told FROM {_A}")
def proj_describe_action(spark, sf_dir):
    return proposals(spark, sf_dir).select("id", A.described(F.col("action"), F.col("target_id"), F.col("params")).alias("told"))


@query("proj_trace_id", "SELECT event_id AS id, 'trace_' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS trace_id FROM events")
def proj_trace_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), A.trace_id(F.col("event_id")).alias("trace_id"))


@query("proj_describe_error", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'server_rejected' ELSE 'execution_failed' END AS code, 'm' || event_id AS message FROM events")
def proj_describe_error(spark, sf_dir):
    code = F.when(F.col("event_id") % 3 == 0, "server_rejected").when(F.col("event_id") % 3 == 1, "odd")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), A.error_of(code, F.concat(F.lit("m"), F.col("event_id").cast("string"))).alias("e")).select("id", "e.*")


@query("sink_reason_http", "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'invalid_response' WHEN event_id % 5 = 0 THEN 'server_unreachable' WHEN event_id % 5 = 1 THEN 'server_rejected' WHEN event_id % 3 = 0 THEN 'invalid_response' END AS code FROM events")
def sink_reason_http(spark, sf_dir):
    e = F.col("event_id")
    status = F.when(e % 5 == 0, None).when(e % 5 == 1, 503).otherwise(200)
    return table(spark, sf_dir, "events").select(e.alias("id"), A.reply_error(e % 7 != 0, status, e % 3 != 0).alias("code"))


# -- strict validation of JSON payloads

_PAYLOADS = """SELECT event_id AS id, CASE event_id % 10 WHEN 0 THEN '{{"action":"click","target_id":"M1","params":{{}},"confidence":0.8,"risk":"low","explanation":"e","reasoning_trace_id":"t"}}'
    WHEN 1 THEN '{{"action":"click","params":{{}},"confidence":0.8,"risk":"low","explanation":"e","reasoning_trace_id":"t"}}' WHEN 2 THEN '{{"action":"none","confidence":1.5,"risk":"low","explanation":"e","reasoning_trace_id":"t"}}'
    WHEN 3 THEN '{{"action":"none","confidence":0.5,"risk":"low","explanation":"e","reasoning_trace_id":"t","extra":1}}' WHEN 4 THEN '{{"action":"dance","confidence":0.5,"risk":"low","explanation":"e","reasoning_trace_id":"t"}}'
    WHEN 5 THEN 'not json' WHEN 6 THEN '{{"action":"blocked","params":{{"reason":"login_required"}},"confidence":0,"risk":"low","explanation":"e","reasoning_trace_id":"t"}}' WHEN 7 THEN '{{"action":"blocked","confidence":0,"risk":"low","explanation":"e","reasoning_trace_id":"t"}}'
    WHEN 8 THEN '{{"action":"none","confidence":"high","risk":"low","explanation":"e","reasoning_trace_id":"t"}}' ELSE '{{"action":"none","confidence":0.5,"risk":"low","explanation":"","reasoning_trace_id":"t"}}' END AS json FROM {events}"""


@query("flt_schema_valid", "SELECT event_id AS id, event_id % 10 IN (0, 6) AS valid FROM events")
def flt_schema_valid(spark, sf_dir):
    return sql(spark, sf_dir, _PAYLOADS).select("id", contract.valid_action(F.col("json")).alias("valid"))


_CONTEXTS = """SELECT event_id AS id, '{{"schema_version":"1.' || CAST(event_id % 3 AS STRING) || '","task":"' || CASE WHEN event_id % 7 = 0 THEN '' ELSE 'do it' END || '","elements":[{{"mark_id":"' || CASE WHEN event_id % 5 = 0 THEN 'X1' ELSE 'M1' END || '","role":"button","text":"ok","bbox":[1,2,3' || CASE WHEN event_id % 11 = 0 THEN '' ELSE ',4' END || ']}}]'
    || CASE WHEN event_id % 4 = 0 THEN ',"step":{{"n":' || CAST(event_id % 60 AS STRING) || ',"limit":15}}' ELSE '' END || '}}' AS json FROM {events}"""


@query("flt_context_valid", "SELECT event_id AS id, event_id % 3 < 2 AND event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0 AND NOT (event_id % 4 = 0 AND (event_id % 60 < 1 OR event_id % 60 > 50)) AS valid FROM events")
def flt_context_valid(spark, sf_dir):
    return sql(spark, sf_dir, _CONTEXTS).select("id", contract.valid_context(F.col("json")).alias("valid"))


# -- the loop

_S = f"{duck(STEPS)} AS s"
_STALL = f"""SELECT task_id, step, state, CAST(sum(CASE WHEN state = 'none' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id, island ORDER BY step) AS BIGINT) AS stalled
    FROM (SELECT *, sum(CASE WHEN state = 'none' THEN 0 ELSE 1 END) OVER (PARTITION BY task_id ORDER BY step) AS island FROM {_S}) AS t"""


@query("win_stall_counter", f"SELECT task_id, step, stalled FROM ({_STALL}) AS t")
def win_stall_counter(spark, sf_dir):
    return L.stalls(sql(spark, sf_dir, STEPS)).select("task_id", "step", "stalled")


_ENDS = f"SELECT task_id, step, CASE WHEN state IN ('done', 'blocked', 'failed') THEN state WHEN stalled >= 2 THEN 'no_progress' WHEN step >= 15 THEN 'budget_exhausted' END AS status FROM ({_STALL}) AS t WHERE step <= 15"
_LOOP = f"SELECT task_id, coalesce((array_agg(status ORDER BY step) FILTER (status IS NOT NULL))[1], 'running') AS status, CAST(coalesce(min(step) FILTER (status IS NOT NULL), max(step)) AS INT) AS steps FROM ({_ENDS}) AS e GROUP BY task_id"


@query("fold_task_loop", _LOOP)
def fold_task_loop(spark, sf_dir):
    """The batch fold of the loop; the stream gives the same rows for tasks that end."""
    return L.finished(sql(spark, sf_dir, STEPS))


@query("proj_synthesized", f"SELECT id, CASE WHEN action IN ('click', 'navigate') OR (action = 'type' AND is_field) THEN 'executed ' || action END AS outcome FROM {_A}")
def proj_synthesized(spark, sf_dir):
    report = A.synthesized(F.col("action"), F.lit("button"), F.lit("Page"), F.col("is_field"))
    return proposals(spark, sf_dir).select("id", report["outcome"].alias("outcome"))


@query("join_step_rescue", f"SELECT s.task_id, s.step, coalesce(r.outcome, CASE WHEN s.action IN ('click', 'navigate') THEN 'executed ' || s.action END) AS outcome FROM (SELECT task_id, step, action FROM {_S}) AS s LEFT JOIN (SELECT task_id, step, 'reported' AS outcome FROM {_S} WHERE step % 3 = 0) AS r ON s.task_id = r.task_id AND s.step = r.step")
def join_step_rescue(spark, sf_dir):
    """A late report is preferred; else what the step's proposal lets one conclude."""
    steps = sql(spark, sf_dir, STEPS).select("task_id", "step", "action")
    late = steps.where("step % 3 = 0").select("task_id", "step", F.lit("reported").alias("late"))
    guess = A.synthesized(F.col("action"), F.lit(None).cast("string"), F.lit(""), F.lit(False))["outcome"]
    return steps.join(late, ["task_id", "step"], "left").select("task_id", "step", F.coalesce("late", guess).alias("outcome"))


@query("limit_history", f"SELECT task_id, CAST(step AS INT) AS n, action, target_role, substr(outcome, 1, 120) AS outcome, substr(page_ident, 1, 120) AS page_ident FROM {_S} WHERE step <= 15", also=("proj_truncate_history",))
def limit_history(spark, sf_dir):
    return L.history(sql(spark, sf_dir, STEPS))


@query("sink_sent_ring", f"SELECT task_id, seq FROM {_S} WHERE task_id = (SELECT task_id FROM {_S} ORDER BY seq DESC LIMIT 1) ORDER BY seq DESC LIMIT 15")
def sink_sent_ring(spark, sf_dir):
    return L.sent_ring(sql(spark, sf_dir, STEPS)).select("task_id", "seq")


@query("sink_results_ring", f"SELECT task_id, last FROM (SELECT task_id, max(seq) AS last FROM {_S} GROUP BY task_id) AS t ORDER BY last DESC LIMIT 20")
def sink_results_ring(spark, sf_dir):
    ends = sql(spark, sf_dir, STEPS).groupBy("task_id").agg(F.max("seq").alias("last"))
    return ends.orderBy(F.desc("last")).limit(20)


@query("win_latest_active", f"SELECT user_id, task_id FROM (SELECT CAST(floor(task_id / 1000) AS BIGINT) AS user_id, task_id, row_number() OVER (PARTITION BY floor(task_id / 1000) ORDER BY min(seq) DESC, task_id) AS n FROM {_S} GROUP BY task_id) AS t WHERE n = 1")
def win_latest_active(spark, sf_dir):
    started = sql(spark, sf_dir, STEPS).groupBy("task_id").agg(F.min("seq").alias("started"))
    return started.groupBy(F.floor(F.col("task_id") / 1000).alias("user_id")).agg(F.max_by("task_id", F.struct("started", -F.col("task_id"))).alias("task_id"))


@query("proj_summary", f"SELECT task_id, count(*) AS observed, count(*) FILTER (state = 'executed') AS executed, count(*) FILTER (state = 'none') AS idle, (array_agg(state ORDER BY step DESC))[1] AS outcome FROM {_S} GROUP BY task_id")
def proj_summary(spark, sf_dir):
    n = lambda s: F.count_if(F.col("state") == s)
    return sql(spark, sf_dir, STEPS).groupBy("task_id").agg(F.count("*").alias("observed"), n("executed").alias("executed"), n("none").alias("idle"), F.max_by("state", "step").alias("outcome"))


@query("flt_hostable_tab", """SELECT task, tab FROM (SELECT user_id AS task, event_id AS tab, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END, ts DESC, event_id) AS n FROM events WHERE event_id % 5 <> 0) AS t WHERE n = 1""")
def flt_hostable_tab(spark, sf_dir):
    """The active web tab of the window, else any active one, else the one used last."""
    e = F.col("event_id")
    tabs = table(spark, sf_dir, "events").where(e % 5 != 0)
    rank = F.when((e % 3 == 0) & (e % 2 == 0), 0).when(e % 3 == 0, 1).otherwise(2)
    return tabs.groupBy(F.col("user_id").alias("task")).agg(F.min_by("event_id", F.struct(rank, -F.unix_micros(F.col("ts").cast("timestamp")), e)).alias("tab"))
