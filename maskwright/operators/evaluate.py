"""Evaluation: recall, precision, F1, leaks, medians, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, if_none: float = 0.0) -> Column:
    return F.when(b == 0, if_none).otherwise(a / b)


def covers(spans: Column, text: Column, kind: Column, value: Column) -> Column:
    """A resolved span of the type overlaps the value's first place in the text."""
    at = F.instr(text, value) - 1
    return F.exists(spans, lambda s: (s["type"] == kind) & (s["start"] < at + F.length(value)) & (s["end"] > at))


def label_text(texts: DataFrame, key: str = "truth_id", order: str = "ord", text: str = "text") -> DataFrame:
    """One text a label: the last one, as in a map that is overwritten."""
    return texts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(text, order).alias(text))


def first_context(rows: DataFrame, keys: list[str], order: str = "ord", text: str = "text") -> DataFrame:
    """The first text of each key."""
    return rows.groupBy(*keys).agg(F.min_by(text, order).alias(text))


def recall_by_type(labels: DataFrame) -> DataFrame:
    """``labels``: type, value, text (null: not perceived), found. One row a type, the worst first."""
    seen = labels.where(F.col("text").isNotNull())
    out = seen.groupBy("type").agg(F.count_if("found").alias("found"), F.count("*").alias("total"))
    missed = seen.where("NOT found").select("type", "value").distinct()
    from pyspark.sql.window import Window

    few = missed.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("value"))).where("n <= 6").groupBy("type").agg(F.array_sort(F.collect_list("value")).alias("missed"))
    return out.join(few, "type", "left").select("type", "found", "total", F.round(F.col("found") / F.col("total"), 6).alias("recall"), F.coalesce("missed", F.array().cast("array<string>")).alias("missed"))


def recall_total(labels: DataFrame) -> DataFrame:
    seen = F.col("text").isNotNull()
    return labels.agg(F.count_if(seen & F.col("found")).alias("found"), F.count_if(seen).alias("total"), F.count_if(~seen).alias("unperceived"))


def reviewed(detections: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``detections`` (type, value) with the verdict that their (type, value) got in a review; null without one."""
    return detections.join(verdicts.select("type", "value", "verdict"), ["type", "value"], "left")


def verdict_tally(detections: DataFrame) -> DataFrame:
    """``detections``: verdict of each, ``labelled`` for injected values. Precision counts real values and wrong types as right."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    rows = detections.agg(n("labelled").alias("labelled"), n("real").alias("real"), n("wrong_type").alias("wrong_type"), n("false_positive").alias("false_positive"), F.count_if(F.col("verdict").isNull()).alias("unreviewed"))
    right, all_ = F.col("labelled") + F.col("real") + F.col("wrong_type"), F.col("labelled") + F.col("real") + F.col("wrong_type") + F.col("false_positive") + F.col("unreviewed")
    return rows.select("*", F.round(ratio(right, all_), 6).alias("precision"), F.round(ratio(right - F.col("wrong_type"), all_), 6).alias("type_precision"))


def element_f1(screens: DataFrame) -> DataFrame:
    """``screens``: expected, transmitted, matched, role_ok, name_ok of each."""
    s = screens.agg(*[F.sum(c).alias(c) for c in ("expected", "transmitted", "matched", "role_ok", "name_ok")])
    m = F.col("matched")
    return s.select(
        "expected", "transmitted", "matched",
        F.round(ratio(m, F.col("transmitted")), 6).alias("precision"),
        F.round(ratio(m, F.col("expected")), 6).alias("recall"),
        F.round(ratio(2 * m, F.col("expected") + F.col("transmitted")), 6).alias("f1"),
        F.round(ratio(F.col("role_ok"), m), 6).alias("role_agreement"),
        F.round(ratio(F.col("name_ok"), m), 6).alias("name_agreement"),
    )


def face_score(scenes: DataFrame) -> DataFrame:
    """``scenes``: labelled, detected, matched. Nothing detected is a precision of 1."""
    s = scenes.agg(*[F.sum(c).alias(c) for c in ("labelled", "detected", "matched")])
    return s.select("*", F.round(ratio(F.col("matched"), F.col("labelled"), 1.0), 6).alias("recall"), F.round(ratio(F.col("matched"), F.col("detected"), 1.0), 6).alias("precision"))


def span_score(want: Column, got: Column) -> Column:
    """``struct<tp, fn, fp>``: each wanted span claims the first free overlapping one, in order. Spans have start and end."""
    empty = F.array().cast("array<int>")

    def claim(used: Column, w: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(got) - 1), lambda i: ~F.array_contains(used, i) & (F.get(got, i)["start"] < w["end"]) & (F.get(got, i)["end"] > w["start"]))
        return F.when((F.size(got) > 0) & (F.size(free) > 0), F.concat(used, F.slice(free, 1, 1))).otherwise(used)

    tp = F.size(F.aggregate(want, empty, claim))
    return F.struct(tp.alias("tp"), (F.size(want) - tp).alias("fn"), (F.size(got) - tp).alias("fp"))


def reasoner_accuracy(answers: DataFrame, model: str = "model") -> DataFrame:
    """``answers``: model, correct, millis. One row a model: correct, total, median and slowest."""
    return answers.groupBy(model).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"), F.round(F.median("millis"), 6).alias("median"), F.max("millis").alias("slowest"))


def dataset_index(elements: DataFrame, screen: str, value: str) -> DataFrame:
    """One row: screens, elements, and elements that hold a labelled value."""
    return elements.agg(F.countDistinct(screen).alias("screens"), F.count("*").alias("elements"), F.count(value).alias("pii"))


def median_rounded(x: Column) -> Column:
    """The middle value; of an even count the mean of the middle two, rounded half up."""
    return F.floor(F.median(x) + 0.5)


def median_upper(column: str) -> Column:
    """The middle value of a column; of an even count the upper one. Exact; partial counts of values are combined."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def threshold_sweep(cases: DataFrame, thresholds: list[float], group: str = "group", score: str = "score") -> DataFrame:
    """Rejected and kept cases of each group at each threshold; one pass over the cases."""
    rows = cases.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(F.col(score) < t).alias(f"r{i}") for i, t in enumerate(thresholds)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"r{i}").alias("rejected")) for i, t in enumerate(thresholds)]))
    return rows.select(group, "total", each.alias("e")).select(group, "e.threshold", "e.rejected", (F.col("total") - F.col("e.rejected")).alias("kept"))


def leaks(values: DataFrame, payloads: DataFrame, screen: str = "screen_id", critical: tuple[str, ...] = ("EMAIL", "PHONE", "PAN", "AADHAAR", "CARD", "OTP")) -> DataFrame:
    """Labelled values (type, value) that occur in their screen's payload, with their family."""
    hit = values.join(payloads, screen).where(F.contains("payload", F.col("value")))
    return hit.select(screen, "type", "value", F.when(F.col("type").isin(*critical), "critical").otherwise("unstructured").alias("family"))


def injected_excluded(detections: DataFrame, known: DataFrame, screen: str = "screen_id") -> DataFrame:
    """Detections that neither hold nor lie within a known value of their screen."""
    k = known.select(F.col(screen).alias("__s"), F.col("value").alias("__v"))
    return detections.join(k, (F.col(screen) == F.col("__s")) & (F.contains("value", F.col("__v")) | F.contains("__v", F.col("value"))), "left_anti")


def payload_reduction(payload: Column, raw: Column) -> Column:
    return 1 - F.length(payload) / F.length(raw)


def profile(runs: DataFrame, task: str = "task", run: str = "run") -> DataFrame:
    """Run 0 is cold; medians of the others. ``other`` is the wall time without vision and reasoning."""
    rows = runs.withColumn("other", F.col("wall") - F.col("vision") - F.col("reason"))
    warm = lambda c: median_rounded(F.when(F.col(run) > 0, F.col(c))).alias(f"warm_{c}")
    return rows.groupBy(task).agg(F.max(F.when(F.col(run) == 0, F.col("wall"))).alias("cold"), *map(warm, ("wall", "vision", "reason", "other")), (F.max("memory") - F.max(F.when(F.col(run) == 0, F.col("memory")))).alias("memory_delta"))
