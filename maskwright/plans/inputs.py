"""Inputs of the queries: the driver's tables, and frames derived from them.

Derived frames are written in the SQL that Spark and DuckDB share, so that a
query and its reference statement start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Invented people; the flag tells whether the given name is in the gazetteer.
PEOPLE = [
    ("Ramesh Iyer", 1), ("Anita Sharma", 1), ("Vikrant Bhardwaj", 0), ("Priya Nair", 1), ("Tanmay Chakraborty", 0), ("Suresh Patil", 1),
    ("Kiet Nguyen", 0), ("Deepa Menon", 1), ("Arjun Rao", 1), ("Zubin Mistry", 0), ("Fatima Sheikh", 1), ("Neil Dsouza", 1),
]
_PEOPLE = ", ".join(f"({i}, '{n}', {k})" for i, (n, k) in enumerate(PEOPLE))


def _digits(expr: str, n: int) -> str:
    return f"lpad(CAST(({expr}) % {10**n} AS STRING), {n}, '0')"


_K = "c_custkey"
_TEMPLATES = [
    ("NAME", "'Signed in as '", "name", "''"),
    ("PHONE", "'Helpline '", f"CAST(6 + {_K} % 4 AS STRING) || {_digits(f'{_K} * 7919 + 17', 9)}", "''"),
    ("PHONE", "'Office '", f"'0' || CAST(20 + {_K} % 70 AS STRING) || '-' || CAST(2000 + {_K} % 7000 AS STRING) || {_digits(f'{_K} * 31', 4)}", "' (day)'"),
    ("EMAIL", "'Write to '", f"'user' || CAST({_K} AS STRING) || '@example.com'", "' today'"),
    ("PAN", "'PAN '", f"'ABCDE' || {_digits(f'{_K} * 37', 4)} || 'F'", "' on record'"),
    ("AADHAAR", "'Aadhaar '", f"CAST(2000 + {_K} % 4000 AS STRING) || ' ' || {_digits(f'{_K} * 53', 4)} || ' ' || {_digits(f'{_K} * 97', 4)}", "''"),
    ("CARD", "'Card '", f"'4' || {_digits(f'{_K} * 104729', 7)} || {_digits(f'{_K} * 1299709', 8)}", "' on file'"),
    ("OTP", "''", f"'OTP is ' || {_digits(f'{_K} * 11 + 100000', 6)}", "' for login'"),
    ("ADDRESS", "'Address: '", f"'Flat ' || CAST(1 + {_K} % 90 AS STRING) || ', Nehru Road, Pune 411001'", "''"),
    (None, "'Download Report'", None, "''"),
]
#: Labelled texts: customer, scope_id (50 customers share one), ord, type, value (null: nothing to find), v_start, text.
PERSONA = " UNION ALL ".join(
    f"""SELECT c_custkey AS customer, c_custkey % 50 AS scope_id, c_custkey * 10 + {i} AS ord, {f"'{t}'" if t else 'CAST(NULL AS STRING)'} AS type,
    {v or 'CAST(NULL AS STRING)'} AS value, {f'length({a})' if v else 'CAST(NULL AS INT)'} AS v_start, {a} || {v or "''"} || {z} AS text, p.known AS known
    FROM {{customer}} JOIN (VALUES {_PEOPLE}) AS p(k, name, known) ON c_custkey % {len(PEOPLE)} = p.k"""
    for i, (t, a, v, z) in enumerate(_TEMPLATES)
)

_ROLE = "CASE l_partkey % 6 WHEN 0 THEN 'button' WHEN 1 THEN 'link' WHEN 2 THEN 'text_field' WHEN 3 THEN 'heading' WHEN 4 THEN 'menuitem' ELSE 'img' END"
_TEXT = "CASE l_suppkey % 5 WHEN 0 THEN 'Download Report' WHEN 1 THEN 'open statement ' || CAST(l_partkey AS STRING) WHEN 2 THEN 'Monthly report, final' WHEN 3 THEN 'Help' ELSE 'Policy 24' END"
#: Elements: screen_id, ord, role, text, sensitive, x, y, w, h.
ELEMENTS = f"""SELECT l_orderkey AS screen_id, l_linenumber AS ord, {_ROLE} AS role, {_TEXT} AS text, l_suppkey % 7 = 0 AS sensitive,
    l_partkey % 40 * 10 AS x, l_suppkey % 20 * 10 AS y, 60 + l_linenumber * 5 AS w, 20 + l_partkey % 3 * 5 AS h
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber)"""
TASK = "Download the monthly report"

#: Boxes of two sources that overlap now and then: screen_id, ord, source, x, y, w, h, score.
BOXES = """SELECT CAST(floor(l_orderkey / 20) AS BIGINT) AS screen_id, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN (l_partkey + l_suppkey + l_linenumber) % 2 = 0 THEN 'dom' ELSE 'vision_ocr' END AS source,
    l_partkey % 4 * 3 + l_partkey % 25 * 40 AS x, l_suppkey % 3 * 2 + l_suppkey % 10 * 30 AS y, 90 + l_partkey % 5 AS w, 28 + l_suppkey % 4 AS h, CAST(l_partkey * 7 % 100 AS DOUBLE) / 100 AS score
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""

#: Labelled and detected faces, the latter somewhat off: screen_id, ord, source, x, y, w, h.
FACES = """SELECT p_partkey AS screen_id, k AS ord, 'label' AS source, k * 100 + p_size AS x, p_size * 2 AS y, 60 AS w, 80 AS h FROM {part} JOIN (VALUES (0), (1), (2), (3)) AS t(k) ON k < p_size % 5
    UNION ALL SELECT p_partkey AS screen_id, k + 10 AS ord, 'face' AS source, k * 100 + p_size + p_partkey % 9 * 5 AS x, p_size * 2 + p_partkey % 4 * 3 AS y, 60 AS w, 80 AS h FROM {part} JOIN (VALUES (0), (1), (2), (3), (4)) AS t(k) ON k < p_size % 6"""

#: Proposals: id, action, target_id, confidence, risk, sensitive, exists_, is_field, p_text, p_url, p_reason, p_top (null: absent).
ACTIONS = """SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'scroll' WHEN 3 THEN 'navigate' WHEN 4 THEN 'none' WHEN 5 THEN 'done' ELSE 'blocked' END AS action,
    CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'M' || CAST(user_id % 9 AS STRING) END AS target_id, CAST(event_id * 13 % 101 AS DOUBLE) / 100 AS confidence,
    CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk, user_id % 5 = 0 AS sensitive, user_id % 4 <> 0 AS exists_, user_id % 2 = 0 AS is_field,
    CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '' ELSE 'hello' END AS p_text, CASE WHEN user_id % 4 = 1 THEN NULL ELSE 'https://example.com/' || CAST(user_id AS STRING) END AS p_url,
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bored' WHEN 2 THEN 'login_required' ELSE 'bot_detection' END AS p_reason,
    CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '250' ELSE 'far' END AS p_top
    FROM {events}"""

#: Step reports: task_id, step, state, action, target_role, outcome, page_ident.
STEPS = """SELECT user_id * 1000 + CAST(floor(n / 20) AS BIGINT) AS task_id, n % 20 + 1 AS step, seq, CASE WHEN event_id % 41 = 7 THEN 'done' WHEN event_id % 53 = 9 THEN 'blocked' WHEN event_id % 67 = 3 THEN 'failed' WHEN event_type = 'error' THEN 'none' ELSE 'executed' END AS state,
    event_type AS action, CASE WHEN event_id % 2 = 0 THEN 'button' ELSE NULL END AS target_role, repeat(event_type || ' ', 40) AS outcome, 'Page ' || CAST(event_id % 9 AS STRING) AS page_ident
    FROM (SELECT event_id, event_type, user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM {events})"""


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run shared SQL; ``{name}`` stands for a table of ``sf_dir``."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(text: str) -> str:
    """The same statement for DuckDB, in parentheses."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", text) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, dealt over all cores if it has fewer files than cores.

    A small file has one row group and so one task with rows, while detection
    costs far more than moving them; tables of many files are not shuffled.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
