"""Queries of evaluation: recall, precision, F1, medians, sweeps, leaks, and the file sources."""

from __future__ import annotations


from pyspark.sql import functions as F

from maskwright.functions import names, pii
from maskwright.operators import context as C
from maskwright.operators import evaluate as E
from maskwright.operators import redact as R
from maskwright.plans.detect import persona_spans
from maskwright.plans.inputs import PEOPLE, PERSONA, duck, sql, table
from maskwright.plans.screen import _GREEDY, boxes, face_matches
from maskwright.sources.readers import persist

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


_P = f"{duck(PERSONA)} AS p"


def _labels(spark, sf_dir):
    """Persona labels: every thirteenth was never perceived, every seventh is garbled and so missed."""
    rows = sql(spark, sf_dir, PERSONA).where("type IS NOT NULL")
    text = F.when(F.col("ord") % 13 == 0, None).when(F.col("ord") % 7 == 0, "garbled").otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("found_", pii.all_spans(F.col("text"), names.unstructured(F.col("text"))))
    rows = rows.withColumn("spans", pii.resolved(F.col("found_")))
    return rows.select("type", "value", "text", F.coalesce(E.covers(F.col("spans"), F.col("text"), F.col("type"), F.col("value")), F.lit(False)).alias("found"))


_SEEN = f"(SELECT type, value, ord % 13 <> 0 AS seen, ord % 13 <> 0 AND ord % 7 <> 0 AS found FROM {_P} WHERE type IS NOT NULL) AS l"


@query("agg_recall_by_type", f"SELECT type, count(*) FILTER (found) AS found, count(*) AS total, round(count(*) FILTER (found) / CAST(count(*) AS DOUBLE), 6) AS recall FROM {_SEEN} WHERE seen GROUP BY type")
def agg_recall_by_type(spark, sf_dir):
    return E.recall_by_type(_labels(spark, sf_dir)).drop("missed")


@query("limit_missed", f"SELECT type, value FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY value) AS n FROM (SELECT DISTINCT type, value FROM {_SEEN} WHERE seen AND NOT found) AS d) AS t WHERE n <= 6")
def limit_missed(spark, sf_dir):
    return E.recall_by_type(_labels(spark, sf_dir)).select("type", F.explode("missed").alias("value"))


@query("agg_recall_total", f"SELECT count(*) FILTER (seen AND found) AS found, count(*) FILTER (seen) AS total, count(*) FILTER (NOT seen) AS unperceived FROM {_SEEN}")
def agg_recall_total(spark, sf_dir):
    return E.recall_total(_labels(spark, sf_dir))


@query("join_label_lookup", "SELECT user_id AS truth_id, (array_agg(event_type ORDER BY event_id DESC))[1] AS text FROM events WHERE user_id % 4 <> 0 GROUP BY user_id")
def join_label_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("truth_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("text"))
    return E.label_text(rows)


@query("join_context_row", "SELECT user_id, event_type, (array_agg(props ORDER BY event_id))[1] AS text FROM events GROUP BY user_id, event_type")
def join_context_row(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("ord"), F.col("props").alias("text"))
    return E.first_context(rows, ["user_id", "event_type"])


_VERDICT = "CASE event_id % 11 WHEN 0 THEN 'labelled' WHEN 1 THEN 'labelled' WHEN 2 THEN 'real' WHEN 3 THEN 'wrong_type' WHEN 4 THEN NULL ELSE 'false_positive' END"


#: Reviewed values: every eleventh event's (type, value) has the verdict of its remainder; remainder 4 was not reviewed.
_REVIEWED = f"SELECT DISTINCT event_type AS type, event_id % 1000 AS value, {_VERDICT.replace('event_id', '(event_id % 1000)')} AS verdict FROM {{events}}"


@query("join_verdict", f"SELECT event_id, {_VERDICT.replace('event_id', '(event_id % 1000)')} AS verdict FROM events")
def join_verdict(spark, sf_dir):
    """Detections take the verdict of their (type, value); those without one are kept."""
    reviewed = sql(spark, sf_dir, _REVIEWED).where("verdict IS NOT NULL")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), (F.col("event_id") % 1000).alias("value"))
    return E.reviewed(rows, reviewed).select("event_id", "verdict")


_TALLY = f"SELECT count(*) FILTER (v = 'labelled') AS labelled, count(*) FILTER (v = 'real') AS real, count(*) FILTER (v = 'wrong_type') AS wrong_type, count(*) FILTER (v = 'false_positive') AS false_positive, count(*) FILTER (v IS NULL) AS unreviewed, count(*) AS n FROM (SELECT {_VERDICT.replace('event_id', '(event_id % 1000)')} AS v FROM events) AS t"


@query("agg_verdict_tally", f"SELECT labelled, real, wrong_type, false_positive, unreviewed, round((labelled + real + wrong_type) / CAST(n AS DOUBLE), 6) AS precision, round((labelled + real) / CAST(n AS DOUBLE), 6) AS type_precision FROM ({_TALLY}) AS t")
def agg_verdict_tally(spark, sf_dir):
    return E.verdict_tally(join_verdict(spark, sf_dir))


@query("agg_distinct_values", f"SELECT DISTINCT event_id % 100 AS value FROM events WHERE {_VERDICT.replace('event_id', '(event_id % 1000)')} IS NULL")
def agg_distinct_values(spark, sf_dir):
    return join_verdict(spark, sf_dir).where("verdict IS NULL").select((F.col("event_id") % 100).alias("value")).distinct()


_KNOWN = f"(SELECT scope_id AS screen_id, value FROM {_P} WHERE type = 'NAME' AND ord % 3 = 0) AS k"
_SEENV = f"(SELECT scope_id AS screen_id, ord, CASE WHEN ord % 2 = 0 THEN value ELSE value || ' Jr' END AS value FROM {_P} WHERE type = 'NAME') AS d"


@query("join_injected_exclusion", f"SELECT screen_id, ord FROM {_SEENV} WHERE NOT EXISTS (SELECT 1 FROM {_KNOWN} WHERE k.screen_id = d.screen_id AND (contains(d.value, k.value) OR contains(k.value, d.value)))")
def join_injected_exclusion(spark, sf_dir):
    rows = sql(spark, sf_dir, PERSONA).where("type = 'NAME'").withColumnRenamed("scope_id", "screen_id")
    seen = rows.select("screen_id", "ord", F.when(F.col("ord") % 2 == 0, F.col("value")).otherwise(F.concat("value", F.lit(" Jr"))).alias("value"))
    return E.injected_excluded(seen, rows.where("ord % 3 = 0").select("screen_id", "value")).select("screen_id", "ord")


_LEAKS = f"SELECT p.customer AS screen_id, p.type, p.value, CASE WHEN p.type IN ('NAME', 'ADDRESS') THEN 'unstructured' ELSE 'critical' END AS family FROM {_P} WHERE p.type IS NOT NULL AND p.customer % 3 = 0"


@query("join_leak_scan", _LEAKS)
def join_leak_scan(spark, sf_dir):
    """Values in payloads: every third payload was sent raw, the others redacted."""
    rows = persona_spans(spark, sf_dir)
    sent = F.when(F.col("customer") % 3 == 0, F.col("text")).otherwise(R.redacted(F.col("text"), F.col("spans"))["text"])
    payloads = rows.groupBy(F.col("customer").alias("screen_id")).agg(F.array_join(F.array_sort(F.collect_list(sent)), "\n").alias("payload"))
    values = rows.where("type IS NOT NULL").select(F.col("customer").alias("screen_id"), "type", "value")
    return E.leaks(values, payloads)


@query("agg_leaks", f"SELECT family, count(*) AS n FROM ({_LEAKS}) AS l GROUP BY family")
def agg_leaks(spark, sf_dir):
    return join_leak_scan(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"))


_COUNTS = f"SELECT (SELECT count(*) FROM (SELECT 1 FROM {{b}} WHERE source = 'dom') AS t) AS expected, (SELECT count(*) FROM (SELECT 1 FROM {{b}} WHERE source <> 'dom') AS t) AS transmitted, (SELECT count(*) FROM ({_GREEDY.replace('{', '{{').replace('}', '}}')}) AS g) AS matched"


def _f1_sql() -> str:
    from maskwright.plans.inputs import BOXES

    counts = _COUNTS.format(b=f"{duck(BOXES)} AS b")
    return f"SELECT expected, transmitted, matched, round(matched / CAST(transmitted AS DOUBLE), 6) AS precision, round(matched / CAST(expected AS DOUBLE), 6) AS recall, round(2 * matched / CAST(expected + transmitted AS DOUBLE), 6) AS f1 FROM ({counts}) AS t"


@query("agg_element_f1", _f1_sql())
def agg_element_f1(spark, sf_dir):
    both = persist(boxes(spark, sf_dir).select("screen_id", "ord", "source", "bbox"), "boxes")
    want, got = (both.where(F.col("source") == x) for x in ("dom", "vision_ocr"))
    m = C.matched(C.overlaps(want, got, 0.5)).groupBy("screen_id").agg(F.count("*").alias("matched"))
    n = both.groupBy("screen_id").agg(F.count_if(F.col("source") == "dom").alias("expected"), F.count_if(F.col("source") != "dom").alias("transmitted"))
    rows = n.join(m, "screen_id", "left").select("expected", "transmitted", F.coalesce("matched", F.lit(0)).alias("matched"), F.lit(0).alias("role_ok"), F.lit(0).alias("name_ok"))
    return E.element_f1(rows).drop("role_agreement", "name_agreement")


def _scenes_sql() -> str:
    from maskwright.plans.inputs import FACES
    from maskwright.plans.screen import FACE_MATCHES

    n = f"SELECT count(*) FILTER (source = 'label') AS labelled, count(*) FILTER (source = 'face') AS detected FROM {duck(FACES)} AS f"
    return f"SELECT labelled, detected, matched, round(matched / CAST(labelled AS DOUBLE), 6) AS recall, round(matched / CAST(detected AS DOUBLE), 6) AS precision FROM (SELECT *, (SELECT count(*) FROM ({FACE_MATCHES}) AS g) AS matched FROM ({n}) AS c) AS t"


@query("agg_face_score", _scenes_sql())
def agg_face_score(spark, sf_dir):
    rows, matched = face_matches(spark, sf_dir)
    counts = rows.groupBy("screen_id").agg(F.count_if(F.col("source") == "label").alias("labelled"), F.count_if(F.col("source") == "face").alias("detected"))
    found = matched.groupBy("screen_id").agg(F.count("*").alias("matched"))
    return E.face_score(counts.join(found, "screen_id", "left").select("labelled", "detected", F.coalesce("matched", F.lit(0)).alias("matched")))


@query("agg_span_score", "SELECT p_partkey AS id, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS INT) AS tp, CAST(CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS INT) AS fn, CAST(CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS INT) AS fp FROM part")
def agg_span_score(spark, sf_dir):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    want = F.array(span(0, 10), span(20, 30))
    got = F.when(F.col("p_size") % 2 == 0, F.array(span(5, 12), span(29, 40))).otherwise(F.array(span(5, 12), span(30, 40)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), E.span_score(want, got).alias("s")).select("id", "s.*")


@query("agg_median", "SELECT user_id, CAST(floor(median(value) + 0.5) AS BIGINT) AS rounded, round(median(value), 6) AS plain, (list_sort(list(value)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper FROM events GROUP BY user_id")
def agg_median(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(E.median_rounded(v).alias("rounded"), F.round(F.median(v), 6).alias("plain"), E.median_upper("value").alias("upper"))


@query("agg_vision", "SELECT round(avg(value), 6) AS mean, count(*) FILTER (value > 20) AS many, (list_sort(list(value)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper FROM events")
def agg_vision(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").agg(F.round(F.avg(v), 6).alias("mean"), F.count_if(v > 20).alias("many"), E.median_upper("value").alias("upper"))


_RUNS = "SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run, event_id % 900 + 300 AS wall, event_id % 90 AS vision, event_id % 17 AS reason, event_id % 500 AS memory FROM {events}"


@query("agg_profile", f"SELECT task, max(wall) FILTER (run = 0) AS cold, CAST(floor(median(wall) FILTER (run > 0) + 0.5) AS BIGINT) AS warm_wall, CAST(floor(median(vision) FILTER (run > 0) + 0.5) AS BIGINT) AS warm_vision, CAST(floor(median(reason) FILTER (run > 0) + 0.5) AS BIGINT) AS warm_reason, CAST(floor(median(wall - vision - reason) FILTER (run > 0) + 0.5) AS BIGINT) AS warm_other, max(memory) - max(memory) FILTER (run = 0) AS memory_delta FROM {duck(_RUNS)} AS r GROUP BY task")
def agg_profile(spark, sf_dir):
    return E.profile(sql(spark, sf_dir, _RUNS))


@query("agg_threshold_sweep", "SELECT event_type AS \"group\", t AS threshold, count(*) FILTER (value / 100 < t) AS rejected, count(*) FILTER (NOT value / 100 < t) AS kept FROM events, (VALUES (0.3), (0.5), (0.7), (0.9)) AS s(t) GROUP BY event_type, t".replace("t AS threshold", "CAST(t AS DOUBLE) AS threshold"))
def agg_threshold_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), (F.col("value") / 100).alias("score"))
    return E.threshold_sweep(rows, [0.3, 0.5, 0.7, 0.9])


@query("agg_reasoner_accuracy", "SELECT event_type AS model, count(*) FILTER (event_id % 3 <> 0) AS correct, count(*) AS total, round(median(value), 6) AS median, max(value) AS slowest FROM events GROUP BY event_type")
def agg_reasoner_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 3 != 0).alias("correct"), F.col("value").alias("millis"))
    return E.reasoner_accuracy(rows)


@query("agg_dataset_index", f"SELECT count(DISTINCT customer) AS screens, count(*) AS elements, count(value) AS pii FROM {_P}")
def agg_dataset_index(spark, sf_dir):
    return E.dataset_index(sql(spark, sf_dir, PERSONA), "customer", "value")


@query("join_persona", f"SELECT c_custkey, name FROM customer JOIN (VALUES {', '.join(f'({i}, {n!r})' for i, (n, _) in enumerate(PEOPLE))}) AS p(k, name) ON c_custkey % {len(PEOPLE)} = k")
def join_persona(spark, sf_dir):
    people = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(PEOPLE)], "k long, name string")
    return table(spark, sf_dir, "customer").join(F.broadcast(people), F.col("c_custkey") % len(PEOPLE) == F.col("k")).select("c_custkey", "name")
