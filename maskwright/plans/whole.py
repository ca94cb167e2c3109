"""Queries of the whole firewall, of file sources and sinks, of pixels, and of timeouts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from maskwright.functions import pixels, verifier
from maskwright.functions.actions import ACTIONS, RISKS
from maskwright.operators.prepare import prepared
from maskwright.plans.detect import _TOKENS
from maskwright.plans.inputs import PERSONA, duck, sql, table
from maskwright.sources import readers

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


_P = f"{duck(PERSONA)} AS p"


def _prepared(spark, sf_dir):
    rows = sql(spark, sf_dir, PERSONA)
    box = F.struct(*[F.lit(v).alias(k) for k, v in zip("xywh", (0, 0, 9, 9), strict=True)]).alias("bbox")
    elements = rows.select("scope_id", "ord", F.when(F.col("ord") % 10 == 9, "heading").otherwise("button").alias("role"), "text", box, (F.col("ord") % 77 == 5).alias("sensitive"))
    titles = rows.select("scope_id").distinct().select("scope_id", F.concat(F.lit("Inbox of user"), F.col("scope_id").cast("string"), F.lit("@example.com "), F.repeat(F.lit("x"), 200)).alias("title"))
    return prepared(elements, F.lit("nothing to see"), titles)


@query("prepare_context", f"""SELECT p.scope_id, 'M' || row_number() OVER (PARTITION BY p.scope_id ORDER BY p.ord) AS mark_id, substr(p.text, 1, CAST(p.v_start AS BIGINT)) || t.token || substr(p.text, CAST(p.v_start + length(p.value) + 1 AS BIGINT)) AS text
    FROM {_P} JOIN ({_TOKENS}) AS t ON p.scope_id = t.scope_id AND p.type = t.type AND p.value = t.value WHERE p.ord % 77 <> 5 AND p.ord % 10 <> 9""")
def prepare_context(spark, sf_dir):
    return _prepared(spark, sf_dir)[0].select("scope_id", "mark_id", "text")


@query("proj_page_ident", f"SELECT DISTINCT scope_id, substr('Inbox of [PII_EMAIL_01] ' || repeat('x', 200), 1, 120) AS page_ident FROM {_P}")
def proj_page_ident(spark, sf_dir):
    return _prepared(spark, sf_dir)[1]


# -- files

_SCREENS = [{"id": f"s{i}", "type": "form", "elements": [{"oracleId": f"ax_{j}", "role": "link", "name": "n", "bbox": [j, 0, 5, 5]} for j in range(i + 1)], "pii": [], "texts": []} for i in range(4)]


def _files(spark, lines: list[str]) -> str:
    """A folder with one file a record."""
    path = readers.scratch(spark, "files")
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").repartitionByRange(len(lines), "i").select("value").write.text(path)
    return path


@query("scan_screens_json", "SELECT 's' || i AS id, i + 1 AS n FROM (VALUES (0), (1), (2), (3)) AS t(i)")
def scan_screens_json(spark, sf_dir):
    folder = _files(spark, [json.dumps(x, indent=1) for x in _SCREENS])
    return readers.screens(spark, folder, "part-*").select("id", F.size("elements").alias("n"))


@query("scan_truths_index", "SELECT 's' || i AS id FROM (VALUES (1), (3)) AS t(i)")
def scan_truths_index(spark, sf_dir):
    folder = _files(spark, [json.dumps(x) for x in _SCREENS])
    index = _files(spark, [json.dumps({"version": "1", "rows": [{"id": "s1"}, {"id": "s3"}, {"id": "s9"}]})])
    return readers.indexed_screens(spark, folder, index, "part-*").select("id")


@query("scan_review", "SELECT 'NAME' AS type, 'v' || i AS value, i AS n, 'real' AS verdict FROM (VALUES (0), (1), (2)) AS t(i)")
def scan_review(spark, sf_dir):
    entries = [{"type": "NAME", "value": f"v{i}", "count": i, "screens": ["s"], "verdict": "real"} for i in range(3)]
    return readers.review(spark, _files(spark, [json.dumps({"entries": entries}, indent=2)])).select("type", "value", F.col("count").alias("n"), "verdict")


@query("scan_gzip_html", "SELECT page_id, md5(replace(html, chr(10), ' ')) AS h FROM pages")
def scan_gzip_html(spark, sf_dir):
    """Pages written as gzipped text and read again."""
    path = readers.scratch(spark, "pages")
    table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit("|"), F.replace("html", F.lit("\n"), F.lit(" "))).alias("value")).write.option("compression", "gzip").text(path)
    line = F.split("value", r"\|", 2)
    return spark.read.text(path).select(F.get(line, F.lit(0)).cast("long").alias("page_id"), F.md5(F.get(line, F.lit(1)).cast("binary")).alias("h"))


@query("sink_eval_json", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def sink_eval_json(spark, sf_dir):
    """A report written as JSON and read again."""
    path = readers.scratch(spark, "report")
    report = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    readers.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("response_schema")
def response_schema(spark, sf_dir):
    """The shape that a model's answer must have."""
    text = {"type": "string"}
    shape = {"action": {"enum": list(ACTIONS)}, "target_id": {"anyOf": [text, {"type": "null"}]}, "params": {"type": "object", "additionalProperties": text}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "risk": {"enum": list(RISKS)}, "explanation": text | {"minLength": 1}}
    return spark.createDataFrame([(json.dumps({"type": "object", "properties": shape, "required": list(shape), "additionalProperties": False}),)], "schema string")


# -- pixels and scores


def _images(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 7 + 4).alias("w"), (F.col("p_size") % 5 + 3).alias("h")).distinct()
    # Every pixel has its own colour, so an image that is shifted, turned or cut differs.
    pixel = lambda i: F.concat(*[F.lpad(F.hex(i * k % 256), 2, "0") for k in (1, 3, 7)], F.lit("FF"))
    return rows.withColumn("rgba", F.unhex(F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("w") * F.col("h")), pixel), "")))


_DIMS = "(SELECT DISTINCT p_size % 7 + 4 AS w, p_size % 5 + 3 AS h FROM part) AS d"


@query("is_fully_masked", f"SELECT w, h, true AS inside, false AS wider, false AS turned, false AS outside FROM {_DIMS}")
def is_fully_masked(spark, sf_dir):
    box = lambda x, y, w, h: F.struct(*[F.lit(v).cast("int").alias(k) for k, v in zip("xywh", (x, y, w, h), strict=True)])
    rows = _images(spark, sf_dir).withColumn("m", pixels.masked(F.col("rgba"), F.col("w"), F.col("h"), F.array(box(1, 1, 3, 1))))
    proof = lambda b: pixels.fully_masked(F.col("m"), F.col("w"), F.col("h"), b)
    return rows.select("w", "h", proof(box(1, 1, 3, 1)).alias("inside"), proof(box(0, 1, 3, 1)).alias("wider"), proof(box(1, 1, 1, 2)).alias("turned"), proof(box(-1, 0, 1, 1)).alias("outside"))


_TENSOR = f"""SELECT w, h, x, y, CAST(least(w - 1, floor((x - l) / s)) AS BIGINT) AS cx, CAST(least(h - 1, floor((y - t) / s)) AS BIGINT) AS cy
    FROM (SELECT *, floor((32 - w * s) / 2) AS l, floor((32 - h * s) / 2) AS t, floor(w * s + 0.5) AS wide, floor(h * s + 0.5) AS high FROM (SELECT w, h, least(CAST(32 AS DOUBLE) / w, CAST(32 AS DOUBLE) / h) AS s FROM {_DIMS}) AS a) AS b,
    (SELECT unnest(range(32)) AS x) AS xs, (SELECT unnest(range(32)) AS y) AS ys WHERE x >= l AND x < l + wide AND y >= t AND y < t + high"""


@query("to_model_input", f"SELECT w, h, CAST(3072 AS INT) AS n, sum((cy * w + cx + 1) * 7 % 256 * (y * 32 + x)) AS blue, sum((cy * w + cx + 1) * 3 % 256 * (y * 32 + x)) AS green, sum((cy * w + cx + 1) % 256 * (y * 32 + x)) AS red FROM ({_TENSOR}) AS t GROUP BY w, h".replace("sum(", "CAST(sum(").replace(") AS blue", ") AS BIGINT) AS blue").replace(") AS green", ") AS BIGINT) AS green").replace(") AS red", ") AS BIGINT) AS red"))
def to_model_input(spark, sf_dir):
    """Each plane's values, weighed by their places."""
    rows = _images(spark, sf_dir).withColumn("t", pixels.model_input(F.col("rgba"), F.col("w"), F.col("h"), 32))
    plane = lambda k: F.aggregate(F.transform(F.slice("t", k * 1024 + 1, 1024), lambda v, i: v.cast("long") * i), F.lit(0).cast("long"), lambda s, v: s + v)
    return rows.select("w", "h", F.size("t").alias("n"), plane(0).alias("blue"), plane(1).alias("green"), plane(2).alias("red"))


def _lum(r: str, g: str, b: str) -> str:
    part = lambda c: f"CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
    return f"({part(r)} * 0.2126 + {part(g)} * 0.7152 + {part(b)} * 0.0722)"


@query("contrast", f"SELECT DISTINCT p_size, round(1.05 / (l + 0.05), 6) AS ratio FROM (SELECT p_size, {_lum('CAST(p_size * 5 AS DOUBLE)', 'CAST(p_size * 3 AS DOUBLE)', 'CAST(p_size AS DOUBLE)')} AS l FROM part) AS t")
def contrast(spark, sf_dir):
    s = F.col("p_size")
    white = pixels.luminance(F.lit(255), F.lit(255), F.lit(255))
    return table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", F.round(pixels.contrast(pixels.luminance(s * 5, s * 3, s), white), 6).alias("ratio"))


@query("per_probability", "SELECT event_id, round(greatest(exp(event_id % 7 - 7.0), exp(event_id % 3 - 7.0)) / (exp(event_id % 5 - 7.0) + exp(event_id % 7 - 7.0) + exp(event_id % 3 - 7.0) + exp(1 - 7.0)), 6) AS p FROM events")
def per_probability(spark, sf_dir):
    e = F.col("event_id")
    logits = F.array(*[x.cast("double") for x in (e % 5, e % 7, e % 3, F.lit(1))])
    return table(spark, sf_dir, "events").select("event_id", F.round(verifier.person_share(logits), 6).alias("p"))


@query("score_span", "SELECT event_id, CAST(CASE WHEN s >= 20 THEN 0.0 WHEN s >= 10 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS score FROM (SELECT event_id, event_id % 25 AS s FROM events) AS t")
def score_span(spark, sf_dir):
    """Tokens at 0-5 (0.2), 5-10 (0.9), 10-20 (0.7); a span of six characters."""
    s = (F.col("event_id") % 25).cast("int")
    tokens = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).alias("share")) for a, b, p in ((0, 0, 1.0), (0, 5, 0.2), (5, 10, 0.9), (10, 20, 0.7))])
    return table(spark, sf_dir, "events").select("event_id", verifier.best_share(tokens, s, s + 6).alias("score"))


@query("str_affix", "SELECT c_custkey, substr(c_name, 10) AS tail, CAST(strpos(c_name, '#') AS INT) AS at, contains(c_name, '#00') AS has, starts_with(c_name, 'Cust') AS starts, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded FROM customer")
def str_affix(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.substring(name, 10, 1000).alias("tail"), F.instr(name, "#").alias("at"), F.contains(name, F.lit("#00")).alias("has"), name.startswith("Cust").alias("starts"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"))
