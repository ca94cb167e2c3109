"""Queries of small parts: attributes, filters, maps, generators, images, captures, schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import actions as A
from maskwright.functions import contract, names, pii, pixels, verifier
from maskwright.functions import text as T
from maskwright.operators import context as C
from maskwright.operators import generate
from maskwright.plans.act import proposals
from maskwright.plans.detect import _PHONES, _known, _sql_spans
from maskwright.plans.inputs import ACTIONS, PERSONA, duck, sql, table, texts
from maskwright.plans.whole import _DIMS, _images
from maskwright.sources import html as H
from maskwright.sources import png, readers

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# -- attributes and filters

_FIELDS = """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'textarea' ELSE 'div' END AS tag, CASE event_id % 5 WHEN 0 THEN 'PassWord' WHEN 1 THEN 'hidden' WHEN 2 THEN 'text' ELSE NULL END AS kind,
    CASE event_id % 7 WHEN 0 THEN ' CC-Number ' WHEN 1 THEN 'one-time-code' WHEN 2 THEN 'email' ELSE NULL END AS autocomplete, CASE event_id % 11 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE NULL END AS marked FROM {events}"""


@query("flt_credential", f"SELECT id, coalesce(trim(lower(autocomplete)) IN ('cc-number', 'one-time-code'), false) OR (tag = 'input' AND coalesce(lower(kind) IN ('password', 'hidden'), false)) OR coalesce(marked = 'true', false) AS credential FROM {duck(_FIELDS)} AS f")
def flt_credential(spark, sf_dir):
    return sql(spark, sf_dir, _FIELDS).select("id", C.credential(F.col("tag"), F.col("kind"), F.col("autocomplete"), F.col("marked")).alias("credential"))


_SHOWN = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS hidden, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE NULL END AS aria_hidden, event_id % 6 * 10 AS w, event_id % 7 * 10 AS h,
    CASE event_id % 9 WHEN 0 THEN 'none' WHEN 1 THEN 'block' ELSE NULL END AS display, CASE event_id % 8 WHEN 0 THEN 'hidden' WHEN 1 THEN 'visible' ELSE NULL END AS visibility FROM {events}"""


@query("flt_perceivable", f"SELECT id FROM {duck(_SHOWN)} AS s WHERE NOT coalesce(hidden, false) AND coalesce(aria_hidden, '') <> 'true' AND w > 0 AND h > 0 AND coalesce(display, '') <> 'none' AND coalesce(visibility, '') <> 'hidden'")
def flt_perceivable(spark, sf_dir):
    return sql(spark, sf_dir, _SHOWN).where(C.perceivable(*map(F.col, ("hidden", "aria_hidden", "w", "h", "display", "visibility")))).select("id")


@query("html_attr", """SELECT page_id, count(*) AS links, CAST(sum(length(h)) AS BIGINT) AS chars, min(h) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) AS t GROUP BY page_id""")
def html_attr(spark, sf_dir):
    """Every link's href of the pages, as the parser reads it."""
    rows = texts(spark, sf_dir, "pages").select("page_id", F.explode(H.attributes(F.col("html"), "a", "href")).alias("h"))
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.sum(F.length("h")).cast("long").alias("chars"), F.min("h").alias("first"))


_GLUED = "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'name: Ramesh Iyer' WHEN 1 THEN 'name: Ramesh Iyer+' WHEN 2 THEN 'name: =Ramesh Iyer' WHEN 3 THEN 'name: Ramesh Iyer/x' WHEN 4 THEN 'name: Ramesh Iyer' || chr(92) ELSE 'name: Ramesh Iyer, ' || c_name END AS text, c_custkey % 6 BETWEEN 1 AND 4 AS glued FROM {customer}"


@query("flt_operator_glue", f"SELECT id, glued FROM {duck(_GLUED)} AS g")
def flt_operator_glue(spark, sf_dir):
    return sql(spark, sf_dir, _GLUED).select("id", (F.size(names.unstructured(F.col("text"))) == 0).alias("glued"))


@query("flt_ocr_conf", "SELECT id, round(c / 100, 4) AS confidence FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice % 100 AS c, l_returnflag AS t FROM lineitem) AS q WHERE c >= 50 AND t <> 'N'")
def flt_ocr_conf(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") % 100).alias("c"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(" ").alias("t"))
    return C.read_words(rows, "t", "c").select("id", F.round("confidence", 4).alias("confidence"))


@query("role_alias", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'textbox' WHEN 1 THEN 'button' WHEN 2 THEN 'link' END AS role FROM events")
def role_alias(spark, sf_dir):
    e = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.role_alias(F.when(e == 0, "text_field").when(e == 1, "button").when(e == 2, "link")).alias("role"))


# -- maps, arrays, choices

_PARAMS = "".join(f"CASE WHEN p_{k} IS NOT NULL THEN '{k}=' || p_{k} || ';' ELSE '' END || " for k in ("reason", "text", "top", "url")) + "''"


@query("map_get", f"SELECT id, p_url AS url, coalesce(p_text, '(none)') AS told, {_PARAMS} AS all_params FROM {duck(ACTIONS)} AS a")
def map_get(spark, sf_dir):
    p = F.col("params")
    line = F.array_join(F.transform(F.array_sort(F.map_entries(p)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    return proposals(spark, sf_dir).select("id", A.param(p, "url").alias("url"), A.param(p, "text", "(none)").alias("told"), line.alias("all_params"))


@query("array_reduce_sum", "SELECT o_custkey AS id, CAST(sum(n) AS BIGINT) AS items, CAST(sum(n * n) AS BIGINT) AS squares FROM (SELECT o_custkey, o_orderkey % 9 AS n FROM orders) AS t GROUP BY o_custkey")
def array_reduce_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.col("o_orderkey") % 9).alias("n"))
    total = lambda f: F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + f(x))
    return rows.select("id", total(lambda x: x).alias("items"), total(lambda x: x * x).alias("squares"))


@query("reason_select", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'model' WHEN event_id % 2 = 0 THEN 'deterministic' ELSE 'deterministic' END AS provider FROM events")
def reason_select(spark, sf_dir):
    """The configured provider if it is available, else the one that always is."""
    e = F.col("event_id")
    wanted, up = F.when(e % 2 == 0, "model").otherwise("deterministic"), e % 3 != 0
    return table(spark, sf_dir, "events").select(e.alias("id"), C.first_available([((wanted == "model") & up, F.lit("model")), (F.lit(True), F.lit("deterministic"))]).alias("provider"))


# -- generators

_TEXT = "'Account ' || c_name || ' of ' || p.name || ', call ' || c_phone || '.'"
_FILLED = f"(SELECT c_custkey, c_name, c_phone, p.name, {_TEXT} AS text FROM (SELECT *, '98765' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS c_phone FROM customer) AS c JOIN (VALUES {{people}}) AS p(k, name) ON c_custkey % {{n}} = p.k) AS t"


def _gen_sql() -> str:
    from maskwright.plans.inputs import PEOPLE

    rows = _FILLED.format(people=", ".join(f"({i}, {n!r})" for i, (n, _) in enumerate(PEOPLE)), n=len(PEOPLE))
    one = lambda kind, col: f"SELECT c_custkey AS id, text, '{kind}' AS type, {col} AS value, CAST(strpos(text, {col}) - 1 AS INT) AS s_start, CAST(strpos(text, {col}) - 1 + length({col}) AS INT) AS s_end FROM {rows}"
    return " UNION ALL ".join(one(k, c) for k, c in (("ACCOUNT", "c_name"), ("NAME", "name"), ("PHONE", "c_phone")))


@query("gen_spans", _gen_sql())
def gen_spans(spark, sf_dir):
    """Texts of a template and the places of their values."""
    from maskwright.plans.inputs import PEOPLE

    people = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(PEOPLE)], "k long, name string")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(people), F.col("c_custkey") % len(PEOPLE) == F.col("k"))
    values = F.create_map(F.lit("account"), F.col("c_name"), F.lit("name"), F.col("name"), F.lit("phone"), F.concat(F.lit("98765"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")))
    made = rows.select(F.col("c_custkey").alias("id"), generate.filled(F.lit("Account {account} of {name}, call {phone}.{rest}"), values).alias("m"))
    return made.select("id", "m.text", F.explode("m.spans").alias("s")).select("id", "text", "s.type", "s.value", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"))


_MARKS = "SELECT c_custkey AS screen, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' ' ELSE '[truth:t' || CAST(c_custkey AS STRING) || '] ' || c_name END AS raw, c_name FROM {customer}"


@query("gen_truth_texts", f"SELECT screen, CASE WHEN screen % 3 <> 0 THEN 't' || screen END AS truth_id, trim(c_name) AS text FROM {duck(_MARKS)} AS m")
def gen_truth_texts(spark, sf_dir):
    return generate.truth_texts(sql(spark, sf_dir, _MARKS), "screen", "raw", r"\[truth:(t[0-9]+)\]")


#: Nodes of an accessibility tree: the parent of a line is the line before, of a screen's first line none.
_NODES = """SELECT l_orderkey AS screen, l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS parent, CASE l_partkey % 4 WHEN 0 THEN 'button' WHEN 1 THEN 'generic' WHEN 2 THEN 'link' ELSE 'heading' END AS role,
    CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'n' || CAST(l_partkey AS STRING) END AS name, l_partkey % 5 = 0 AS ignored, l_partkey % 90 AS a, l_suppkey % 70 AS b, l_partkey % 4 AS c, l_suppkey % 5 AS d
    FROM (SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""


@query("oracle_ax_tree", f"""WITH RECURSIVE n AS (SELECT * FROM {duck(_NODES)} AS q),
    r AS (SELECT screen, id, role, a, b, c, d, nullif(trim(name), '') AS called, parent AS up, 0 AS depth FROM n WHERE NOT ignored AND role IN ('button', 'link', 'heading')
      UNION ALL SELECT r.screen, r.id, r.role, r.a, r.b, r.c, r.d, CASE WHEN n.ignored THEN NULL ELSE nullif(trim(n.name), '') END, n.parent, depth + 1 FROM r LEFT JOIN n ON n.screen = r.screen AND n.id = r.up WHERE r.called IS NULL AND r.up IS NOT NULL AND depth < 8)
    SELECT screen, id, role, coalesce(max(called), '') AS name, least(a, b) AS x, greatest(a, b) - least(a, b) AS w, c + d AS h FROM r WHERE a <> b AND c + d > 0 GROUP BY screen, id, role, a, b, c, d""")
def oracle_ax_tree(spark, sf_dir):
    """Nodes with the name of the nearest ancestor that has one, and the boxes of their quads."""
    quad = F.array("a", F.lit(0), "b", "c", "b", F.col("c") + F.col("d"), "a", F.col("c") + F.col("d"))
    rows = readers.persist(sql(spark, sf_dir, _NODES).withColumn("quad", quad), "nodes")
    return generate.ax_tree(rows).select("screen", "id", "role", "name", "box.x", "box.w", "box.h")


# -- images and captures


@query("scan_png", f"SELECT w, h, list_sum(list_transform(range(1, w * h + 1), lambda i: i % 256 * i + i * 3 % 256 * (i + 1) + i * 7 % 256 * (i + 2))) AS mark FROM {_DIMS}".replace("list_sum(", "CAST(list_sum(").replace(") AS mark", ") AS BIGINT) AS mark"))
def scan_png(spark, sf_dir):
    """Images written as PNG and read again: every pixel's channels, weighed by their place."""
    rows = _images(spark, sf_dir).select(png.encoded(F.col("rgba"), F.col("w"), F.col("h")).alias("png")).select(png.decoded(F.col("png")).alias("i")).select("i.*")
    byte = lambda i, c: F.conv(F.hex(F.substring("rgba", ((i - 1) * 4 + c + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    mark = F.aggregate(F.sequence(F.lit(1).cast("long"), (F.col("width") * F.col("height")).cast("long")), F.lit(0).cast("long"), lambda s, i: s + byte(i, 0) * i + byte(i, 1) * (i + 1) + byte(i, 2) * (i + 2))
    return rows.select(F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"), mark.alias("mark"))


@query("scan_capture", f"SELECT w, h, k, CAST(3 AS INT) AS cut_w, CAST(2 AS INT) AS cut_h, ((k + 0) * 0 + (k * w + k) + 1) % 256 AS first FROM {_DIMS}, (SELECT unnest(range(2)) AS k) AS ks WHERE k + 3 <= w AND k + 2 <= h")
def scan_capture(spark, sf_dir):
    """Regions cut out of a captured image; those that don't lie within it give none."""
    rows = _images(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
    box = F.struct(F.col("k").cast("int").alias("x"), F.col("k").cast("int").alias("y"), F.lit(3).alias("w"), F.lit(2).alias("h"))
    cut = rows.withColumn("c", pixels.cut_out(F.col("rgba"), F.col("w"), F.col("h"), box)).where("c IS NOT NULL")
    return cut.select("w", "h", F.col("k").cast("long").alias("k"), F.lit(3).alias("cut_w"), (F.length("c") / 12).cast("int").alias("cut_h"), F.conv(F.hex(F.substring("c", 1, 1)), 16, 10).cast("long").alias("first"))


# -- contracts, files, models


@query("schema_codegen", "SELECT * FROM (VALUES ('action', 'string', true), ('confidence', 'double', true), ('explanation', 'string', true), ('params', 'map<string,string>', false), ('reasoning_trace_id', 'string', true), ('risk', 'string', true), ('target_id', 'string', false)) AS t(field, type, required)")
def schema_codegen(spark, sf_dir):
    """The Spark schema that a JSON schema asks for."""
    shape = contract.spark_schema(contract.ACTION_SCHEMA)
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), not f.nullable) for f in shape], "field string, type string, required boolean")


@query("file_digest", "SELECT sha256(n_name || chr(10)) AS sha256, CAST(length(n_name) + 1 AS BIGINT) AS length FROM nation")
def file_digest(spark, sf_dir):
    """One file a nation, written and digested."""
    path = readers.scratch(spark, "files")
    n = table(spark, sf_dir, "nation")
    n.repartitionByRange(n.count(), "n_nationkey").select(F.col("n_name").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.digests(spark, f"{path}/part-*").select("sha256", "length")


@query("scan_env", "SELECT c_custkey AS id, 'KEY_' || c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || ' = x' WHEN 2 THEN '' END AS value FROM customer WHERE c_custkey % 4 < 3")
def scan_env(spark, sf_dir):
    """Settings of every customer: plain, quoted, empty, and commented out."""
    k, name = F.col("c_custkey"), F.col("c_name")
    key = F.concat(F.lit("KEY_"), k.cast("string"))
    line = F.when(k % 4 == 0, F.concat(key, F.lit("="), name)).when(k % 4 == 1, F.concat(F.lit(" "), key, F.lit(' = "'), name, F.lit(' = x" '))).when(k % 4 == 2, F.concat(key, F.lit("="))).otherwise(F.concat(F.lit("# "), key, F.lit("="), name))
    return table(spark, sf_dir, "customer").select(k.alias("id"), readers.settings(line).alias("s")).where("s IS NOT NULL").select("id", "s.*")


_PIECES = ["[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *[f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"], "the", "and", "##tion", "##er", ".", ","]


@query("word_piece", r"""SELECT item_id, array_to_string(list_concat(['[CLS]'], flatten(list_transform(regexp_extract_all(strip_accents(lower(text)), '[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+'), lambda w: CASE WHEN w IN ('.', ',') THEN [w]
    WHEN regexp_full_match(w, '[a-z]+') THEN list_concat([regexp_extract(w, '^(the|and|[a-z])')], list_transform(regexp_extract_all(regexp_replace(w, '^(the|and|[a-z])', ''), 'tion|er|[a-z]'), lambda x: '##' || x)) ELSE ['[UNK]'] END)), ['[SEP]']), ' ') AS pieces FROM benchmark""")
def word_piece(spark, sf_dir):
    """Pieces of the benchmark's texts in a small vocabulary of its own."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(verifier.word_pieces(F.col("text"), _PIECES), " ").alias("pieces"))


@query("verify_names", f"SELECT ord, type, value FROM {duck(PERSONA)} AS p WHERE type IS NOT NULL AND NOT (type = 'NAME' AND known = 0)")
def verify_names(spark, sf_dir):
    """Names of all texts after a scorer, which here knows the common given names, has rejected what it is sure about."""
    rows = sql(spark, sf_dir, PERSONA).select("ord", "text")
    return verifier.verified(rows, lambda window, name: 0.9 if name.split()[0].lower() in verifier.GIVEN else 0.01).select("ord", "type", "value")


# -- both families over the labelled texts

_SOURCE = f"(SELECT ord, text FROM {duck(PERSONA)} AS p)"
_UNION = " UNION ALL ".join(
    [f"SELECT *, {i} AS rank FROM ({_sql_spans(k, _SOURCE, 'ord')}) AS t{i}" for i, k in enumerate(("OTP", "EMAIL", "CARD", "AADHAAR", "PAN"))]
    + [f"SELECT ord, type, value, s_start, s_end, confidence, {5 + i} AS rank FROM ({x}) AS p{i}" for i, x in enumerate(_PHONES)]
    + [f"SELECT ord, type, value, s_start, s_end, confidence, 9 AS rank FROM ({_known(k)}) AS u{k}" for k in ("NAME", "ADDRESS")]
)


@query("set_union_all", f"SELECT ord, type, value, s_start, s_end, confidence FROM ({_UNION}) AS u")
def set_union_all(spark, sf_dir):
    """What the two families find in the labelled texts, together; spans may overlap."""
    return sort_all(spark, sf_dir).drop("place")


@query("sort_all", f"SELECT ord, type, value, s_start, s_end, confidence, CAST(row_number() OVER (PARTITION BY ord ORDER BY s_start, s_start - s_end, -confidence, rank) - 1 AS INT) AS place FROM ({_UNION}) AS u")
def sort_all(spark, sf_dir):
    """The same in reading order, the longer first, then the surer."""
    rows = sql(spark, sf_dir, PERSONA).select("ord", pii.all_spans(F.col("text"), names.unstructured(F.col("text"))).alias("spans"))
    return rows.select("ord", F.posexplode("spans").alias("place", "s")).select("ord", "s.type", "s.value", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), "s.confidence", "place")


@query("sort_unstructured", f"SELECT ord, type, value, CAST(row_number() OVER (PARTITION BY ord ORDER BY s_start, s_start - s_end) - 1 AS INT) AS place FROM ({_known('NAME')} UNION ALL {_known('ADDRESS')}) AS u")
def sort_unstructured(spark, sf_dir):
    rows = sql(spark, sf_dir, PERSONA).select("ord", F.posexplode(names.unstructured(F.col("text"))).alias("place", "s"))
    return rows.select("ord", "s.type", "s.value", "place")
