"""Actions: risk tiers, semantic checks, outcomes, descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed domains of the record contract.
RISKS = ("low", "medium", "high")
ACTIONS = ("click", "type", "scroll", "navigate", "none", "done", "blocked")
BLOCK_REASONS = ("bot_detection", "login_required", "cannot_proceed")
PII_TYPES = ("EMAIL", "PHONE", "PAN", "AADHAAR", "CARD", "OTP", "NAME", "ADDRESS")
SOURCES = ("dom", "vision_ocr", "vision_face", "vision_object")
# Messages, as the record contract words them.
NEEDS_TARGET = "a ", " needs a target_id"
UNKNOWN_TARGET = "target_id '", "' is not one of the marks you were given"
NEEDS_TEXT = "a type action needs params.text"
NEEDS_URL = "a navigate action needs params.url"
NEEDS_REASON = "a blocked action needs params.reason, one of bot_detection, login_required, cannot_proceed"
NO_URL = "navigate needs params.url"
NO_TEXT = "type needs params.text"
NO_FIELD = "cannot type into the target"
GONE = "mark ", " is no longer on the page"
NOTHING, FINISHED, STOPPED = "no action proposed", "task reported done", "stopped: "


def _rank(risk: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RISKS)), risk)


def max_risk(a: Column, b: Column) -> Column:
    """The higher of two tiers."""
    return F.when(_rank(a) >= _rank(b), a).otherwise(b)


def local_risk(action: Column, confidence: Column, sensitive: Column) -> Column:
    """Risk by what the action does, whether its target is sensitive, and how sure the proposal is."""
    return (
        F.when(action.isin("none", "done", "blocked"), "low")
        .when((action == "navigate") | F.coalesce(sensitive, F.lit(False)) | (confidence < 0.5), "high")
        .when(confidence < 0.75, "medium")
        .otherwise("low")
    )


def effective_risk(proposed: Column, action: Column, confidence: Column, sensitive: Column) -> Column:
    """The stricter of the proposed and the local tier."""
    return max_risk(proposed, local_risk(action, confidence, sensitive))


def requires_confirmation(risk: Column) -> Column:
    return risk != "low"


def param(params: Column, key: str, default=None) -> Column:
    """A value of a parameter map, or the default."""
    found = F.try_element_at(params, F.lit(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def scroll_top(params: Column) -> Column:
    """The ``top`` parameter as a number: 0 if absent, NaN if it isn't one."""
    text = param(params, "top", "0")
    return F.when(F.trim(text) == "", 0.0).otherwise(F.coalesce(text.try_cast("double"), F.lit(float("nan"))))


def _empty(x: Column) -> Column:
    return x.isNull() | (x == "")


def semantic_problem(action: Column, target: Column, params: Column, marks: Column) -> Column:
    """Why a well-formed proposal can't be meant: null if it can."""
    aimed = action.isin("click", "type")
    unknown = ~F.array_contains(F.coalesce(marks, F.array().cast("array<string>")), F.coalesce(target, F.lit("")))
    return (
        F.when(aimed & _empty(target), F.concat(F.lit(NEEDS_TARGET[0]), action, F.lit(NEEDS_TARGET[1])))
        .when(aimed & unknown, F.concat(F.lit(UNKNOWN_TARGET[0]), target, F.lit(UNKNOWN_TARGET[1])))
        .when((action == "type") & _empty(param(params, "text")), NEEDS_TEXT)
        .when((action == "navigate") & _empty(param(params, "url")), NEEDS_URL)
        .when((action == "blocked") & ~F.coalesce(param(params, "reason").isin(*BLOCK_REASONS), F.lit(False)), NEEDS_REASON)
    )


def kept_target(action: Column, target: Column) -> Column:
    """Only click and type keep a target."""
    return F.when(action.isin("click", "type"), target)


def outcome(action: Column, target: Column, params: Column, exists: Column, is_field: Column) -> Column:
    """``struct<status, reason, detail>`` of executing an action."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    made = lambda status, reason=None, detail=None: F.struct(F.lit(status).alias("status"), (F.lit(None).cast("string") if reason is None else text(reason)).alias("reason"), (F.lit(None).cast("string") if detail is None else text(detail)).alias("detail"))
    return (
        F.when(action == "none", made("skipped", "no_action"))
        .when(action == "done", made("done", None, param(params, "summary", "completed")))
        .when(action == "blocked", made("blocked", param(params, "reason", "cannot_proceed")))
        .when((action == "navigate") & _empty(param(params, "url")), made("failed", "missing_parameter", NO_URL))
        .when(action.isin("navigate", "scroll"), made("executed"))
        .when(_empty(target) | ~F.coalesce(exists, F.lit(False)), made("failed", "stale_target", F.concat(F.lit(GONE[0]), F.coalesce(target, F.lit("<none>")), F.lit(GONE[1]))))
        .when(action == "click", made("executed"))
        .when(~F.coalesce(is_field, F.lit(False)), made("failed", "unsupported_target", NO_FIELD))
        .when(param(params, "text").isNull(), made("failed", "missing_parameter", NO_TEXT))
        .otherwise(made("executed"))
    )


def step_state(action: Column, result: Column) -> Column:
    """``struct<state, outcome>`` of a loop step for an outcome of :func:`outcome`."""
    status, reason = result["status"], result["reason"]
    state = F.when(status == "skipped", "none").otherwise(status)
    text = (
        F.when(status == "executed", F.concat(F.lit("executed "), action))
        .when(status == "skipped", NOTHING)
        .when(status == "done", FINISHED)
        .when(status == "blocked", F.concat(F.lit(STOPPED), reason))
        .otherwise(F.concat(reason, F.lit(": "), result["detail"]))
    )
    return F.struct(state.alias("state"), text.alias("outcome"))


def navigates(action: Column, submits: Column) -> Column:
    """Could executing the proposal have replaced its page?"""
    return action.isin("click", "navigate") | ((action == "type") & F.coalesce(submits, F.lit(False)))


def synthesized(action: Column, target_role: Column, page_ident: Column, submits: Column) -> Column:
    """The report that a lost step is given from its proposal; null if that doesn't navigate."""
    report = F.struct(F.lit("executed").alias("state"), action.alias("action"), target_role.alias("target_role"), F.concat(F.lit("executed "), action).alias("outcome"), F.coalesce(page_ident, F.lit("")).alias("page_ident"))
    return F.when(navigates(action, submits), report)


def described(action: Column, target: Column, params: Column) -> Column:
    """A sentence about an action."""
    told = {
        "click": ("Click ", F.coalesce(target, F.lit("undefined"))),
        "type": ("Type into ", F.coalesce(target, F.lit("undefined"))),
        "navigate": ("Navigate to ", param(params, "url", "an unspecified URL")),
        "done": ("Finish the task: ", param(params, "summary", "completed")),
        "blocked": ("Stop: ", param(params, "reason", "cannot proceed")),
    }
    out = F.when(action == "none", "Take no action").when(action == "scroll", F.concat(F.lit("Scroll the page by "), param(params, "top", "0"), F.lit("px")))
    for name, (verb, what) in told.items():
        out = out.when(action == name, F.concat(F.lit(verb), what))
    return out


def trace_id(key: Column) -> Column:
    """A trace id that depends on a key only, so that reruns agree."""
    return F.concat(F.lit("trace_"), F.substring(F.md5(key.cast("string").cast("binary")), 1, 12))


def settle(delivered: Column, waited_ms: Column, stashed: Column, proposed: Column, navigating: Column, grace_ms: int = 3000, settle_ms: int = 20_000, result_ms: int = 120_000) -> Column:
    """What the loop does about a step that hasn't answered.

    A stashed report wins.  A delivered step is left alone for the grace; then a
    navigating proposal is taken as executed, no proposal means it is sent again,
    any other is waited for until the result's limit.  An undelivered one is
    retried until the settle limit.
    """
    return (
        F.when(stashed, "use_report")
        .when(delivered & (waited_ms >= grace_ms) & proposed & navigating, "synthesize")
        .when(delivered & (waited_ms >= grace_ms) & ~proposed, "redeliver")
        .when(delivered & (waited_ms >= result_ms), "fail")
        .when(delivered, "wait")
        .when(waited_ms >= settle_ms, "fail")
        .otherwise("retry")
    )


# The typed error codes.
ERROR_CODES = ("capability_unavailable", "model_unavailable", "server_unreachable", "server_rejected", "invalid_response", "execution_failed", "cancelled_by_user")


def error_of(code: Column, message: Column) -> Column:
    """Any error as ``struct<code, message>``; an unknown code is a failed execution."""
    return F.struct(F.when(code.isin(*ERROR_CODES), code).otherwise("execution_failed").alias("code"), F.coalesce(message, F.lit("null")).alias("message"))


def reply_error(valid_request: Column, status: Column, valid_reply: Column) -> Column:
    """Error code of a reasoning request, null for a good reply; a null status is no answer."""
    return (
        F.when(~valid_request, "invalid_response")
        .when(status.isNull(), "server_unreachable")
        .when((status < 200) | (status > 299), "server_rejected")
        .when(~valid_reply, "invalid_response")
    )
