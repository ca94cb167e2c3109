"""Queries of detection, resolution, redaction and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import names, pii
from maskwright.operators import redact as R
from maskwright.plans.inputs import PERSONA, duck, sql, table, texts
from maskwright.sources.readers import persist

QUERIES: dict = {}
ORACLE: dict = {}
#: RE2's \b, \d and \w are ASCII, as the detectors want; patterns with look-around are rewritten where they are used.
RE = {"OTP": 0, "EMAIL": 1, "CARD": 2, "AADHAAR": 3, "PAN": 4}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _flat(rows, key: str, spans):
    return rows.select(key, F.explode_outer(spans).alias("s")).where("s IS NOT NULL").select(key, F.col("s.type").alias("type"), F.col("s.value").alias("value"), F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), F.col("s.confidence").alias("confidence"))


_LUHN = """(length(d) >= 13 AND list_sum(list_transform(range(length(d)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(substr(d, CAST(length(d) - k AS BIGINT), 1) AS INT)
    ELSE (CAST(substr(d, CAST(length(d) - k AS BIGINT), 1) AS INT) * 2) % 10 + CAST(floor(CAST(substr(d, CAST(length(d) - k AS BIGINT), 1) AS INT) * 2 / 10) AS INT) END)) % 10 = 0)"""


def _sql_spans(kind: str, source: str = "documents", key: str = "doc_id") -> str:
    p = pii.PATTERNS[RE[kind]][1].replace("'", "''")
    flat = f"""SELECT {key}, '{kind}' AS type, f[i] AS value, regexp_replace(f[i], '[^0-9]', '', 'g') AS d,
        CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS INT) AS s_start
        FROM (SELECT {key}, f, g, unnest(range(1, len(f) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(text, '{p}') AS f, string_split_regex(text, '{p}') AS g FROM {source}) AS a) AS b"""
    sure = f"CASE WHEN {_LUHN} THEN 1.0 ELSE 0.7 END" if kind == "CARD" else "1.0"
    return f"SELECT {key}, type, value, s_start, CAST(s_start + length(value) AS INT) AS s_end, CAST({sure} AS DOUBLE) AS confidence FROM ({flat}) AS c"


def _all_sql(source: str = "documents", key: str = "doc_id") -> str:
    return " UNION ALL ".join(f"SELECT *, {i} AS rank FROM ({_sql_spans(k, source, key)}) AS t{i}" for k, i in RE.items())


def _resolved_sql(source: str = "documents", key: str = "doc_id") -> str:
    return f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s_start, s_start - s_end, rank) AS n FROM ({_all_sql(source, key)}) AS u),
        r AS (SELECT {key}, n, s_end AS cur, true AS kept FROM s WHERE n = 1
              UNION ALL SELECT s.{key}, s.n, CASE WHEN s.s_start >= r.cur THEN s.s_end ELSE r.cur END, s.s_start >= r.cur FROM r JOIN s ON s.{key} = r.{key} AND s.n = r.n + 1)"""


for _kind in ("EMAIL", "CARD", "OTP", "AADHAAR", "PAN"):

    def _make(kind):
        persona = kind in ("OTP", "AADHAAR", "PAN")
        source = f"(SELECT ord, text FROM {duck(PERSONA)} AS p)" if persona else "documents"

        @query(f"pii_{kind.lower()}", _sql_spans(kind, source, "ord" if persona else "doc_id"))
        def run(spark, sf_dir):
            rows = sql(spark, sf_dir, PERSONA) if persona else texts(spark, sf_dir, "documents")
            return _flat(rows, "ord" if persona else "doc_id", pii.of_type(F.col("text"), kind))

    _make(_kind)


_PHONES: list[str] = []


def _phone(name: str, index: int, pattern: str):
    oracle = f"""SELECT ord, 'PHONE' AS type, v AS value, CAST(strpos(text, v) - 1 AS INT) AS s_start, CAST(strpos(text, v) - 1 + length(v) AS INT) AS s_end, CAST(1 AS DOUBLE) AS confidence
        FROM (SELECT ord, text, regexp_extract(text, '{pattern}', 2) AS v FROM {duck(PERSONA)} AS p) AS q WHERE v <> ''"""
    _PHONES.append(oracle)

    @query(name, oracle)
    def run(spark, sf_dir):
        return _flat(sql(spark, sf_dir, PERSONA), "ord", pii.detector(F.col("text"), index))


_phone("pii_phone_mobile", 5, r"(^|\W)((?:\+?91[ -]?)?[6-9]\d{4}[ -]?\d{5})($|\D)")
_phone("pii_phone_landline", 6, r"(^|\W)(0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4})($|\D)")


@query("pii_structured", f"SELECT doc_id, type, value, s_start, s_end, confidence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s_start, s_start - s_end, rank) - 1 AS INT) AS at FROM ({_all_sql()}) AS u")
def pii_structured(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(pii.structured(F.col("text"))).alias("at", "s"))
    return rows.select("doc_id", F.col("s.type").alias("type"), F.col("s.value").alias("value"), F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), F.col("s.confidence").alias("confidence"), "at")


QUERIES["sort_structured"] = pii_structured
ORACLE["sort_structured"] = ORACLE["pii_structured"]


@query("luhn", f"SELECT id, {_LUHN} AS ok FROM (SELECT ord AS id, regexp_replace(coalesce(value, text), '[^0-9]', '', 'g') AS d FROM {duck(PERSONA)} AS p) AS q")
def luhn(spark, sf_dir):
    return sql(spark, sf_dir, PERSONA).select(F.col("ord").alias("id"), pii.luhn(F.coalesce("value", "text")).alias("ok"))


def _known(kind: str) -> str:
    sure = "CASE WHEN known = 1 THEN 0.95 ELSE 0.9 END" if kind == "NAME" else "0.95"
    return f"SELECT ord, type, value, CAST(v_start AS INT) AS s_start, CAST(v_start + length(value) AS INT) AS s_end, CAST({sure} AS DOUBLE) AS confidence FROM {duck(PERSONA)} AS p WHERE type = '{kind}'"


def _unstructured(spark, sf_dir, kind=None):
    rows = _flat(sql(spark, sf_dir, PERSONA), "ord", names.unstructured(F.col("text")))
    return rows.where(F.col("type") == kind) if kind else rows


@query("pii_name", _known("NAME"))
def pii_name(spark, sf_dir):
    return _unstructured(spark, sf_dir, "NAME")


@query("pii_address", _known("ADDRESS"))
def pii_address(spark, sf_dir):
    return _unstructured(spark, sf_dir, "ADDRESS")


@query("pii_unstructured", f"{_known('NAME')} UNION ALL {_known('ADDRESS')}")
def pii_unstructured(spark, sf_dir):
    return _unstructured(spark, sf_dir)


@query("pii_all")
def pii_all(spark, sf_dir):
    """Every detection over all documents, both families."""
    rows = texts(spark, sf_dir, "documents")
    return _flat(rows, "doc_id", pii.all_spans(F.col("text"), names.unstructured(F.col("text"))))



_DOC_SPANS = f"{_resolved_sql()} SELECT s.doc_id, s.type, s.value, s.s_start, s.s_end, s.confidence FROM s JOIN r ON s.doc_id = r.doc_id AND s.n = r.n WHERE r.kept"


@query("resolve_spans", _DOC_SPANS)
def resolve_spans(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents").select("doc_id", pii.structured(F.col("text")).alias("found"))
    return _flat(rows, "doc_id", pii.resolved(F.col("found")))


QUERIES["win_resolve_spans"] = resolve_spans
ORACLE["win_resolve_spans"] = _DOC_SPANS


@query("privacy_decision", "SELECT c AS confidence, CASE WHEN c >= 0.6 THEN 'mask' WHEN c >= 0.4 THEN 'review' ELSE 'allow' END AS decision FROM (SELECT DISTINCT CAST(event_id % 101 AS DOUBLE) / 100 AS c FROM events) AS t")
def privacy_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 101 / F.lit(100.0)).alias("confidence")).distinct()
    return rows.select("confidence", pii.decision(F.col("confidence")).alias("decision"))


@query(
    "redact",
    f"""{_resolved_sql()}, k AS (SELECT s.* FROM s JOIN r ON s.doc_id = r.doc_id AND s.n = r.n WHERE r.kept),
    f AS (SELECT doc_id, type, value, min(s_start) AS first FROM k GROUP BY doc_id, type, value),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first) AS no FROM f),
    p AS (SELECT k.doc_id, k.s_start, k.s_end, lag(k.s_end, 1, 0) OVER (PARTITION BY k.doc_id ORDER BY k.s_start) AS prev, '[PII_' || k.type || '_' || CASE WHEN t.no < 10 THEN '0' || t.no ELSE CAST(t.no AS VARCHAR) END || ']' AS tok
          FROM k JOIN t ON k.doc_id = t.doc_id AND k.type = t.type AND k.value = t.value),
    o AS (SELECT p.doc_id, string_agg(substr(d.text, CAST(prev + 1 AS BIGINT), CAST(p.s_start - prev AS BIGINT)) || tok, '' ORDER BY p.s_start) AS head, max(p.s_end) AS last, count(*) AS n FROM p JOIN documents d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
    SELECT d.doc_id, CASE WHEN o.n IS NULL THEN d.text ELSE o.head || substr(d.text, CAST(o.last + 1 AS BIGINT)) END AS text, CAST(coalesce(o.n, 0) AS INT) AS n_matches, false AS requires_review FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id""",
)
def redact(spark, sf_dir):
    """The flagship: structured data of every document as tokens, each document a scope of its own."""
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = rows.withColumn("found", pii.structured(F.col("text"))).withColumn("spans", pii.resolved(F.col("found")))
    out = hits.withColumn("r", R.redacted(F.col("text"), F.col("spans")))
    return out.select("doc_id", F.col("r.text").alias("text"), F.size("r.matches").alias("n_matches"), F.col("r.requires_review").alias("requires_review"))


@query("proj_redacted_span", _DOC_SPANS.replace("s.value, ", ""))
def proj_redacted_span(spark, sf_dir):
    return resolve_spans(spark, sf_dir).drop("value")


@query("redact_all")
def redact_all(spark, sf_dir):
    """All detectors over every document."""
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = rows.withColumn("found", pii.all_spans(F.col("text"), names.unstructured(F.col("text")))).withColumn("spans", pii.resolved(F.col("found")))
    out = hits.withColumn("r", R.redacted(F.col("text"), F.col("spans")))
    return out.select("doc_id", F.col("r.text").alias("text"), F.size("r.matches").alias("n_matches"), F.col("r.requires_review").alias("requires_review"), F.col("r.tokens").alias("tokens"))


def persona_spans(spark, sf_dir):
    """The labelled texts with their resolved spans, written: detection costs far more than reading them again."""
    rows = sql(spark, sf_dir, PERSONA)
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "ord").withColumn("found", pii.all_spans(F.col("text"), names.unstructured(F.col("text"))))
    return persist(rows.withColumn("spans", pii.resolved(F.col("found"))).drop("found"), "spans")


_TOKENS = f"""SELECT scope_id, type, value, no AS number, '[PII_' || type || '_' || CASE WHEN no < 10 THEN '0' || no ELSE CAST(no AS VARCHAR) END || ']' AS token
    FROM (SELECT scope_id, type, value, row_number() OVER (PARTITION BY scope_id, type ORDER BY min(ord)) AS no FROM {duck(PERSONA)} AS p WHERE type IS NOT NULL GROUP BY scope_id, type, value) AS q"""


@query("tokenize", _TOKENS)
def tokenize(spark, sf_dir):
    return R.token_map(R.span_rows(persona_spans(spark, sf_dir), ["scope_id", "ord"]))


QUERIES["win_token_number"] = tokenize
ORACLE["win_token_number"] = _TOKENS


@query("redact_scopes", f"SELECT p.scope_id, p.ord, CASE WHEN p.value IS NULL THEN p.text ELSE substr(p.text, 1, CAST(p.v_start AS BIGINT)) || t.token || substr(p.text, CAST(p.v_start + length(p.value) + 1 AS BIGINT)) END AS text, p.type AS pii_type, CAST(p.value IS NOT NULL AS INT) AS n_matches, false AS requires_review FROM {duck(PERSONA)} AS p LEFT JOIN ({_TOKENS}) AS t ON p.scope_id = t.scope_id AND p.type = t.type AND p.value = t.value")
def redact_scopes(spark, sf_dir):
    out = R.redact_scopes(persona_spans(spark, sf_dir).select("scope_id", "ord", "text", "spans"))
    return out.select("scope_id", "ord", "text", "pii_type", "n_matches", "requires_review")


@query("detokenize", f"SELECT p.ord, t.value FROM {duck(PERSONA)} AS p JOIN ({_TOKENS}) AS t ON p.scope_id = t.scope_id AND p.type = t.type AND p.value = t.value")
def detokenize(spark, sf_dir):
    rows = persona_spans(spark, sf_dir)
    tokens = R.token_map(R.span_rows(rows, ["scope_id", "ord"]))
    text = R.redact_scopes(rows.select("scope_id", "ord", "text", "spans"))
    found = text.select("scope_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(r"\[PII_[A-Z]+_\d+\]"), F.lit(0))).alias("token"))
    return R.detokenized(found, tokens).select("ord", "value")


@query("agg_redacted_counts", f"SELECT scope_id, count(*) FILTER (type IS NOT NULL) AS redacted, CAST(0 AS BIGINT) AS withheld, count(DISTINCT type || ':' || value) AS tokens, CAST(count(*) FILTER (type IS NOT NULL) AS BIGINT) AS spans FROM {duck(PERSONA)} AS p GROUP BY scope_id")
def agg_redacted_counts(spark, sf_dir):
    rows = persona_spans(spark, sf_dir)
    counts = rows.groupBy("scope_id").agg(F.count_if(F.size("spans") > 0).alias("redacted"), F.count_if(F.exists("spans", lambda s: pii.decision(s["confidence"]) == "review")).alias("withheld"), F.sum(F.size("spans")).cast("long").alias("spans"))
    tokens = R.token_map(R.span_rows(rows, ["scope_id", "ord"])).groupBy("scope_id").agg(F.count("*").alias("tokens"))
    return counts.join(tokens, "scope_id").select("scope_id", "redacted", "withheld", "tokens", "spans")


_REJECT = "ord % 20 = 0"


@query("set_except_rejected", f"SELECT ord, type, value FROM {duck(PERSONA)} AS p WHERE type IS NOT NULL AND NOT (type = 'NAME' AND {_REJECT})")
def set_except_rejected(spark, sf_dir):
    """Names that a verifier rejected go before spans are resolved."""
    rows = sql(spark, sf_dir, PERSONA).withColumn("found", pii.all_spans(F.col("text"), names.unstructured(F.col("text"))))
    keys = F.transform(F.filter("found", lambda s: s["type"] == "NAME"), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    rejected = F.when(F.expr(_REJECT), keys).otherwise(F.array().cast("array<string>"))
    kept = rows.withColumn("kept", pii.without(F.col("found"), rejected))
    return _flat(kept, "ord", pii.resolved(F.col("kept"))).select("ord", "type", "value")


@query("guard_pii", f"SELECT ord, coalesce(type NOT IN ('NAME', 'ADDRESS'), false) AS rejected FROM {duck(PERSONA)} AS p")
def guard_pii(spark, sf_dir):
    return sql(spark, sf_dir, PERSONA).select("ord", R.has_structured(F.col("text")).alias("rejected"))
