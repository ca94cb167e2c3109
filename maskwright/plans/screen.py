"""Queries of extraction, fusion, context building, reasoning and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import geometry as G
from maskwright.functions import text as T
from maskwright.operators import context as C
from maskwright.operators import faces
from maskwright.plans.inputs import BOXES, ELEMENTS, FACES, TASK, duck, sql, table, texts
from maskwright.sources import html as H
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


def _boxed(df):
    return df.withColumn("bbox", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def elements(spark, sf_dir):
    return _boxed(sql(spark, sf_dir, ELEMENTS))


def boxes(spark, sf_dir, source=None):
    rows = _boxed(sql(spark, sf_dir, BOXES))
    return rows if source is None else rows.where(F.col("source") == source)


def _both(spark, sf_dir):
    """Boxes of the two sources, aggregated once."""
    rows = persist(boxes(spark, sf_dir).select("screen_id", "ord", "source", "bbox"), "boxes")
    return [rows.where(F.col("source") == x) for x in ("dom", "vision_ocr")]


# -- HTML

#: Links of the pages: the only interactive elements that the driver's pages have.
_LINKS = """SELECT page_id, i AS ord, replace(replace(replace(replace(t[i], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text FROM (
    SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages) AS p) AS q"""


@query("scan_dom", f"SELECT page_id AS screen_id, 'dom_' || ord AS id, CAST(ord AS INT) AS ord, 'link' AS role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM ({_LINKS}) AS l", also=("scan_dom.walk", "win_dom_id", "set_distinct_nodes"))
def scan_dom(spark, sf_dir):
    return H.scan_dom(texts(spark, sf_dir, "pages")).select("screen_id", "id", "ord", "role", "text")


@query("proj_bbox", """SELECT l_orderkey AS id, CAST(floor(l_discount * 100 - 4.5 + 0.5) AS BIGINT) AS x, CAST(floor(l_extendedprice / 7 + 0.5) AS BIGINT) AS w FROM (SELECT l_orderkey, l_discount, l_extendedprice FROM lineitem) AS t""")
def proj_bbox(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("id"), G.js_round(F.col("l_discount") * 100 - 4.5).alias("x"), G.js_round(F.col("l_extendedprice") / 7).alias("w"))


#: Markup made of keys, for what the pages don't have.
_FORMS = """SELECT p_partkey AS page_id, CASE p_partkey % 8 WHEN 0 THEN '<input type="password" name="p">' WHEN 1 THEN '<label for="a">Full name</label><input id="a" name="n">' WHEN 2 THEN '<label>Agree <input type="checkbox"></label>'
    WHEN 3 THEN '<button aria-label="Close">x</button>' WHEN 4 THEN '<div role="tab" hidden>gone</div>' WHEN 5 THEN '<input autocomplete=" CC-Number " placeholder="Card">' WHEN 6 THEN '<select><option>One</option></select>' ELSE '<textarea placeholder="Notes"></textarea>' END AS html, p_partkey % 8 AS kind FROM {part}"""
_FORM_ROWS = f"""SELECT page_id AS screen_id, CASE kind WHEN 1 THEN 'text_field' WHEN 2 THEN 'checkbox' WHEN 3 THEN 'button' WHEN 6 THEN 'combobox' ELSE 'text_field' END AS role,
    CASE kind WHEN 1 THEN 'Full name' WHEN 2 THEN 'Agree' WHEN 3 THEN 'Close' WHEN 6 THEN 'One' ELSE 'Notes' END AS text FROM {duck(_FORMS)} AS f WHERE kind NOT IN (0, 4, 5)"""


@query("scan_dom_forms", _FORM_ROWS, also=("proj_role", "proj_text"))
def scan_dom_forms(spark, sf_dir):
    return H.scan_dom(sql(spark, sf_dir, _FORMS)).select("screen_id", "role", "text")


_IMAGES = """SELECT p_partkey AS page_id, '<img width="' || CAST(p_partkey % 90 AS STRING) || '" height="64" data-x="' || CAST(p_partkey % 1400 AS STRING) || '" data-y="10"' || CASE p_partkey % 4 WHEN 0 THEN ' alt=" A chart "' WHEN 1 THEN ' title="T"' WHEN 2 THEN ' style="opacity:0"' ELSE '' END || '>' AS html,
    p_partkey % 90 AS w, p_partkey % 1400 AS x, p_partkey % 4 AS kind FROM {part}"""


@query("scan_visual_regions", f"SELECT page_id AS screen_id, 'vision_1' AS id, 'img' AS role, CASE kind WHEN 0 THEN 'A chart' WHEN 1 THEN 'T' ELSE '' END AS described_text, CAST(x AS INT) AS x, CAST(10 AS INT) AS y, CAST(least(x + w, 1280) - x AS INT) AS w, CAST(64 AS INT) AS h FROM {duck(_IMAGES)} AS i WHERE w >= 32 AND x < 1280 AND kind <> 2", also=("flt_visible_region",))
def scan_visual_regions(spark, sf_dir):
    return H.scan_visual_regions(sql(spark, sf_dir, _IMAGES)).select("screen_id", "id", "role", "described_text", "bbox.*")


@query("flt_unread_region", f"SELECT page_id AS screen_id FROM {duck(_IMAGES)} AS i WHERE w >= 32 AND x < 1280 AND kind = 3")
def flt_unread_region(spark, sf_dir):
    return H.scan_visual_regions(sql(spark, sf_dir, _IMAGES)).where("described_text = ''").select("screen_id")


_BLOCKED = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN '<div class="g-recaptcha" data-sitekey="k"></div>' || html WHEN 1 THEN html || '<iframe src="https://newassets.hcaptcha.com/x"></iframe>' WHEN 2 THEN '<html><head><title>Just a moment...</title></head><body>wait</body></html>'
    WHEN 3 THEN '<html><head><title>Are you a robot?</title></head><body>' || repeat('long text ', 300) || '</body></html>' WHEN 4 THEN '<div id="px-captcha"></div>' || html ELSE html END AS html FROM {pages}"""


@query("flt_bot_block", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'recaptcha' WHEN 1 THEN 'hcaptcha' WHEN 2 THEN 'cloudflare-interstitial' WHEN 4 THEN 'px-challenge' END AS marker FROM pages")
def flt_bot_block(spark, sf_dir):
    return sql(spark, sf_dir, _BLOCKED).select("page_id", H.bot_marker(F.col("html")).alias("marker"))


@query("capture_freeze", "SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g') AS html FROM pages")
def capture_freeze(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", H.frozen(F.col("html")).alias("html"))


@query("page_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_title(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


# -- context

_E = f"{duck(ELEMENTS)} AS e"
_RELEVANT = "(role IN ('button', 'link', 'text_field', 'checkbox', 'radio', 'combobox', 'menuitem') OR contains(lower(text), 'download') OR contains(lower(text), 'the') OR contains(lower(text), 'monthly') OR contains(lower(text), 'report'))"
_MARKED = f"SELECT screen_id, ord, 'M' || row_number() OVER (PARTITION BY screen_id ORDER BY ord) AS mark_id, role, text, x, y, w, h FROM {_E} WHERE NOT sensitive AND {_RELEVANT}"


@query("flt_relevant", f"SELECT screen_id, ord FROM {_E} WHERE {_RELEVANT}", also=("array_split_filter",))
def flt_relevant(spark, sf_dir):
    return elements(spark, sf_dir).where(C.relevant(F.col("role"), F.col("text"), F.lit(TASK))).select("screen_id", "ord")


@query("flt_sensitive", f"SELECT screen_id, ord FROM {_E} WHERE NOT sensitive")
def flt_sensitive(spark, sf_dir):
    return elements(spark, sf_dir).where(~F.col("sensitive")).select("screen_id", "ord")


@query("win_mark_rank", f"SELECT screen_id, ord, mark_id FROM ({_MARKED}) AS m")
def win_mark_rank(spark, sf_dir):
    return C.marked(elements(spark, sf_dir), F.lit(TASK)).select("screen_id", "ord", "mark_id")


@query("proj_context_element", f"SELECT screen_id, mark_id, role, text, x, y, w, h FROM ({_MARKED}) AS m")
def proj_context_element(spark, sf_dir):
    return C.marked(elements(spark, sf_dir), F.lit(TASK)).select("screen_id", "mark_id", "role", "text", "bbox.*")


_CONTEXT = f"SELECT screen_id, count(*) AS n, string_agg(mark_id || ':' || role || ':' || text || ':' || x || ',' || y || ',' || w || ',' || h, '|' ORDER BY ord) AS payload FROM ({_MARKED}) AS m GROUP BY screen_id"


@query("build_context", _CONTEXT, also=("map_context",))
def build_context(spark, sf_dir):
    out = C.context(elements(spark, sf_dir), F.lit(TASK))
    line = F.transform("elements", lambda e: F.concat_ws(":", e["mark_id"], e["role"], e["text"], F.array_join(F.transform(e["bbox"], lambda b: b.cast("string")), ",")))
    return out.select("screen_id", F.size("elements").cast("long").alias("n"), F.array_join(line, "|").alias("payload"))


_CLICK = f"SELECT screen_id, min(CASE WHEN role IN ('button', 'link', 'menuitem') AND (list_has_any(['download', 'the', 'monthly', 'report'], string_split(lower(text), ' '))) THEN CAST(substr(mark_id, 2) AS INT) END) AS m, screen_id % 5 = 0 AS past FROM ({_MARKED}) AS m GROUP BY screen_id"


@query("reason_deterministic", f"SELECT screen_id, CASE WHEN past THEN 'done' WHEN m IS NOT NULL THEN 'click' ELSE 'none' END AS action, CASE WHEN NOT past THEN 'M' || m END AS target_id, CAST(CASE WHEN past THEN 0.6 WHEN m IS NOT NULL THEN 0.8 ELSE 0.0 END AS DOUBLE) AS confidence FROM ({_CLICK}) AS c", also=("set_intersect_terms",))
def reason_deterministic(spark, sf_dir):
    history = F.when(F.col("screen_id") % 5 == 0, F.array(F.lit("executed click"))).otherwise(F.array(F.lit("no action proposed")))
    return C.deterministic(C.context(elements(spark, sf_dir), F.lit(TASK)), F.lit(TASK), history).select("screen_id", "action", "target_id", "confidence")


@query("join_marks", f"SELECT c.screen_id, m.ord, m.role AS target_role FROM ({_CLICK}) AS c JOIN ({_MARKED}) AS m ON c.screen_id = m.screen_id AND m.mark_id = 'M' || c.m WHERE NOT past", also=("join_target_role",))
def join_marks(spark, sf_dir):
    e = elements(spark, sf_dir)
    history = F.when(F.col("screen_id") % 5 == 0, F.array(F.lit("executed click"))).otherwise(F.array().cast("array<string>"))
    aimed = C.deterministic(C.context(e, F.lit(TASK)), F.lit(TASK), history).where("target_id IS NOT NULL").select("screen_id", F.col("target_id").alias("mark_id"))
    return C.marked(e, F.lit(TASK)).join(aimed, ["screen_id", "mark_id"]).select("screen_id", "ord", F.col("role").alias("target_role"))


@query("proj_prompt", f"SELECT screen_id, 'Task: {TASK}' || chr(10) || 'Step 2 of at most 15.' || chr(10) || chr(10) || 'Elements:' || chr(10) || string_agg('- ' || mark_id || ' [' || role || '] ''' || text || ''' at (' || x || ', ' || y || ', ' || w || ', ' || h || ')', chr(10) ORDER BY ord) || chr(10) || chr(10) || 'Answer with the JSON action.' AS prompt FROM ({_MARKED}) AS m GROUP BY screen_id")
def proj_prompt(spark, sf_dir):
    out = C.context(elements(spark, sf_dir), F.lit(TASK))
    none = F.lit(None).cast("array<struct<action:string,target_role:string,outcome:string,page_ident:string>>")
    return out.select("screen_id", C.prompt(F.lit(TASK), F.lit(2), F.lit(15), F.lit(None).cast("string"), none, F.col("elements")).alias("prompt"))


@query("agg_payload_reduction", f"SELECT screen_id, round(1 - length(payload) / 5000.0, 6) AS reduction FROM ({_CONTEXT}) AS c")
def agg_payload_reduction(spark, sf_dir):
    from maskwright.operators.evaluate import payload_reduction

    return build_context(spark, sf_dir).select("screen_id", F.round(payload_reduction(F.col("payload"), F.repeat(F.lit("x"), 5000)), 6).alias("reduction"))


@query("sort_tokenized_first_limit", f"SELECT screen_id, ord FROM (SELECT screen_id, ord, row_number() OVER (PARTITION BY screen_id % 40 ORDER BY (regexp_matches(text, '[0-9]')) DESC, screen_id, ord) AS n FROM {_E}) AS t WHERE n <= 30")
def sort_tokenized_first_limit(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = elements(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy(F.col("screen_id") % 40).orderBy(F.desc(F.col("text").rlike("[0-9]")), "screen_id", "ord"))
    return rows.withColumn("n", n).where("n <= 30").select("screen_id", "ord")


# -- boxes


def _iou_sql(a: str, b: str) -> str:
    both = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"(CAST({both} AS DOUBLE) / ({a}.w * {a}.h + {b}.w * {b}.h - {both}))"


_B = duck(BOXES)
_D, _V = (f"(SELECT * FROM {_B} AS q WHERE source = '{s}')" for s in ("dom", "vision_ocr"))
_PAIRS = f"SELECT d.screen_id, d.ord AS want, v.ord AS got, {_iou_sql('d', 'v')} AS iou FROM {_D} AS d JOIN {_V} AS v ON d.screen_id = v.screen_id WHERE {_iou_sql('d', 'v')} >= 0.5"


@query("iou", f"SELECT screen_id, want, got, round(iou, 6) AS iou FROM ({_PAIRS}) AS p")
def iou(spark, sf_dir):
    pairs = C.overlaps(*_both(spark, sf_dir), 0.5)
    return pairs.withColumn("iou", F.round("iou", 6))


@query("join_fuse", f"SELECT screen_id, ord, source FROM {_D} AS d UNION ALL SELECT screen_id, ord, source FROM {_V} AS v WHERE NOT EXISTS (SELECT 1 FROM {_D} AS d WHERE d.screen_id = v.screen_id AND {_iou_sql('d', 'v')} >= 0.7)")
def join_fuse(spark, sf_dir):
    return C.fused(*_both(spark, sf_dir)).select("screen_id", "ord", "source")


@query("join_withheld_anti", f"SELECT screen_id, ord FROM {_V} AS v WHERE NOT EXISTS (SELECT 1 FROM {_D} AS d WHERE d.screen_id = v.screen_id AND {_iou_sql('d', 'v')} >= 0.5)")
def join_withheld_anti(spark, sf_dir):
    d = boxes(spark, sf_dir, "dom").select(F.col("screen_id").alias("__s"), F.col("bbox").alias("__b"))
    return C.unmatched(boxes(spark, sf_dir, "vision_ocr"), d, 0.5).select("screen_id", "ord")


@query("join_best_region", f"SELECT screen_id, want, got, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY screen_id, want ORDER BY iou DESC, got) AS n FROM ({_PAIRS}) AS p) AS q WHERE n = 1")
def join_best_region(spark, sf_dir):
    pairs = C.overlaps(*_both(spark, sf_dir), 0.5)
    return C.best_of(pairs).withColumn("iou", F.round("iou", 6))


def _pairs(table: str, left: str, right: str) -> str:
    d, v = (f"(SELECT * FROM {duck(table)} AS q WHERE source = '{s}')" for s in (left, right))
    return f"SELECT d.screen_id, d.ord AS want, v.ord AS got, {_iou_sql('d', 'v')} AS iou FROM {d} AS d JOIN {v} AS v ON d.screen_id = v.screen_id WHERE {_iou_sql('d', 'v')} >= 0.5"


def _greedy(pairs: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY want, iou DESC, got) AS n FROM ({pairs}) AS q),
    r AS (SELECT screen_id, 1 AS n, [want] AS ws, [got] AS gs, true AS took FROM p WHERE n = 1
      UNION ALL SELECT p.screen_id, p.n, CASE WHEN list_contains(r.ws, p.want) OR list_contains(r.gs, p.got) THEN r.ws ELSE list_append(r.ws, p.want) END,
        CASE WHEN list_contains(r.ws, p.want) OR list_contains(r.gs, p.got) THEN r.gs ELSE list_append(r.gs, p.got) END, NOT (list_contains(r.ws, p.want) OR list_contains(r.gs, p.got)) FROM r JOIN p ON p.screen_id = r.screen_id AND p.n = r.n + 1)
    SELECT p.screen_id, p.want, p.got, round(p.iou, 6) AS iou FROM p JOIN r ON p.screen_id = r.screen_id AND p.n = r.n WHERE r.took"""


_GREEDY = _greedy(_PAIRS)
FACE_MATCHES = _greedy(_pairs(FACES, "label", "face"))


def face_matches(spark, sf_dir):
    rows = persist(_boxed(sql(spark, sf_dir, FACES)).select("screen_id", "ord", "source", "bbox"), "faces")
    return rows, C.matched(C.overlaps(rows.where("source = 'label'"), rows.where("source = 'face'"), 0.5))


@query("join_iou_greedy_faces", FACE_MATCHES)
def join_iou_greedy_faces(spark, sf_dir):
    return face_matches(spark, sf_dir)[1].withColumn("iou", F.round("iou", 6))


@query("join_iou_greedy_elements", _GREEDY)
def join_iou_greedy_elements(spark, sf_dir):
    pairs = C.overlaps(*_both(spark, sf_dir), 0.5)
    return C.matched(pairs).withColumn("iou", F.round("iou", 6))


_NMS = f"""WITH RECURSIVE p AS (SELECT screen_id, ord, x, y, w, h, row_number() OVER (PARTITION BY screen_id ORDER BY score DESC, ord) AS n FROM {_V} AS v),
    r AS (SELECT screen_id, n, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS kept, true AS took FROM p WHERE n = 1
      UNION ALL SELECT p.screen_id, p.n, CASE WHEN list_bool_or(list_transform(r.kept, lambda k: {_iou_sql('k', 'p')} >= 0.3)) THEN r.kept ELSE list_append(r.kept, {{'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h}}) END,
        NOT list_bool_or(list_transform(r.kept, lambda k: {_iou_sql('k', 'p')} >= 0.3)) FROM r JOIN p ON p.screen_id = r.screen_id AND p.n = r.n + 1)
    SELECT p.screen_id, p.ord FROM p JOIN r ON p.screen_id = r.screen_id AND p.n = r.n WHERE r.took"""


@query("nms", _NMS, also=("sort_score_nms",))
def nms(spark, sf_dir):
    rows = boxes(spark, sf_dir, "vision_ocr").select("screen_id", F.struct(F.col("ord").alias("id"), "score", "bbox").alias("c"))
    kind = dict(rows.select("c.*").dtypes)
    grouped = rows.groupBy("screen_id").agg(F.collect_list(F.struct("c.id", "c.score", F.col("c.bbox").alias("box"))).alias("c"))
    return grouped.select("screen_id", F.explode(G.suppressed(F.col("c"), G.NMS_AT, f"struct<id:{kind['id']},score:double,box:{kind['bbox']}>")).alias("k")).select("screen_id", F.col("k.id").alias("ord"))


_PAD = "CAST(floor(w * 0.1 + 0.5) AS BIGINT) AS px, CAST(floor(h * 0.1 + 0.5) AS BIGINT) AS py"
_PADDED = f"SELECT ord, greatest(0, x - px) AS x, greatest(0, y - py) AS y, least(800 - greatest(0, x - px), w + px * 2) AS w, least(240 - greatest(0, y - py), h + py * 2) AS h FROM (SELECT *, {_PAD} FROM {_B} AS b) AS t"


@query("padded_box", _PADDED)
def padded_box(spark, sf_dir):
    return _boxed(sql(spark, sf_dir, BOXES)).select("ord", G.padded(F.col("bbox"), F.lit(800), F.lit(240)).alias("p")).select("ord", "p.*")


@query("mask_regions", f"SELECT ord, greatest(0, least(x + w, 800) - greatest(x, 0)) * greatest(0, least(y + h, 240) - greatest(y, 0)) AS painted FROM ({_PADDED}) AS p")
def mask_regions(spark, sf_dir):
    return _boxed(sql(spark, sf_dir, BOXES)).select("ord", G.painted(F.col("bbox"), F.lit(800), F.lit(240)).alias("painted"))


_SIZES = "SELECT DISTINCT p_size * 37 + 64 AS width, p_size * 11 + 50 AS height FROM part"


@query("letterbox", f"SELECT width, height, round(least(640.0 / width, 640.0 / height), 9) AS scale, CAST(floor((640 - width * least(CAST(640 AS DOUBLE) / width, CAST(640 AS DOUBLE) / height)) / 2) AS BIGINT) AS offset_x, CAST(floor((640 - height * least(CAST(640 AS DOUBLE) / width, CAST(640 AS DOUBLE) / height)) / 2) AS BIGINT) AS offset_y FROM ({_SIZES}) AS s")
def letterbox(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_size") * 37 + 64).alias("width"), (F.col("p_size") * 11 + 50).alias("height")).distinct()
    return rows.select("width", "height", G.letterbox(F.col("width"), F.col("height"), 640).alias("f")).select("width", "height", F.round("f.scale", 9).alias("scale"), "f.offset_x", "f.offset_y")


_ANCHORS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 6400 AS idx, l_discount * 10 AS cls, l_tax * 10 AS obj, l_quantity / 50 AS r0, l_discount AS r1, l_tax * 5 AS r2, l_quantity / 40 AS r3 FROM {lineitem}"


@query("decode_stride", f"SELECT id, round(sqrt(greatest(0.0, cls) * greatest(0.0, obj)), 6) AS score, round((idx % 80 + r0) * 8 - exp(r2) * 4, 6) AS x, round((floor(idx / 80) + r1) * 8 - exp(r3) * 4, 6) AS y, round(exp(r2) * 8, 6) AS w, round(exp(r3) * 8, 6) AS h FROM {duck(_ANCHORS)} AS a WHERE sqrt(greatest(0.0, cls) * greatest(0.0, obj)) >= 0.4")
def decode_stride(spark, sf_dir):
    rows = sql(spark, sf_dir, _ANCHORS).select("id", G.decoded(F.col("idx"), F.col("cls"), F.col("obj"), F.array("r0", "r1", "r2", "r3"), 8, 640).alias("d"))
    return rows.where(F.col("d.score") >= G.SCORE_AT).select("id", F.round("d.score", 6).alias("score"), *[F.round(f"d.box.{c}", 6).alias(c) for c in "xywh"])


#: Anchors of three strides: image, id, stride, idx, cls, obj and the four regressions.
_FACE_ANCHORS = """SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS image, l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride,
    l_partkey % CASE l_linenumber % 3 WHEN 0 THEN 900 WHEN 1 THEN 300 ELSE 90 END AS idx, l_discount * 10 AS cls, l_tax * 12 AS obj, l_quantity / 50 AS r0, l_discount * 3 AS r1, 1 + l_tax * 8 AS r2, 1 + l_discount * 8 AS r3
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""
_FACE_BOXES = f"""SELECT image, id, score, cx - w / 2 AS x, cy - h / 2 AS y, w, h FROM (SELECT image, id, sqrt(greatest(0.0, cls) * greatest(0.0, obj)) AS score, (idx % CAST(floor(640 / stride) AS BIGINT) + r0) * stride AS cx, (floor(idx / floor(640 / stride)) + r1) * stride AS cy, exp(r2) * stride AS w, exp(r3) * stride AS h FROM {duck(_FACE_ANCHORS)} AS a) AS t WHERE score >= 0.4"""
_FACES = f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS n FROM ({_FACE_BOXES}) AS b),
    r AS (SELECT image, n, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS kept, true AS took FROM p WHERE n = 1
      UNION ALL SELECT p.image, p.n, CASE WHEN list_bool_or(list_transform(r.kept, lambda k: {_iou_sql('k', 'p')} >= 0.3)) THEN r.kept ELSE list_append(r.kept, {{'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h}}) END,
        NOT list_bool_or(list_transform(r.kept, lambda k: {_iou_sql('k', 'p')} >= 0.3)) FROM r JOIN p ON p.image = r.image AND p.n = r.n + 1)
    SELECT image, id, score, CAST(floor(a + 0.5) AS BIGINT) AS x, CAST(floor(b + 0.5) AS BIGINT) AS y, CAST(floor(c - a + 0.5) AS BIGINT) AS w, CAST(floor(d - b + 0.5) AS BIGINT) AS h
    FROM (SELECT p.image, p.id, round(p.score, 6) AS score, greatest(0.0, least(1280.0, p.x / 0.5)) AS a, greatest(0.0, least(800.0, (p.y - 120) / 0.5)) AS b, greatest(0.0, least(1280.0, (p.x + p.w) / 0.5)) AS c, greatest(0.0, least(800.0, (p.y + p.h - 120) / 0.5)) AS d
          FROM p JOIN r ON p.image = r.image AND p.n = r.n WHERE r.took) AS t"""


@query("detect_faces", _FACES)
def detect_faces(spark, sf_dir):
    """All three strides of an image of 1280 x 800: decoded, suppressed, and back in the image's pixels."""
    rows = sql(spark, sf_dir, _FACE_ANCHORS).withColumn("reg", F.array("r0", "r1", "r2", "r3"))
    return faces.detected(rows, 1280, 800, 640, image="image").select("image", "id", F.round("score", 6).alias("score"), "box.*")


@query("to_image_box", f"SELECT ord, CAST(floor(a + 0.5) AS BIGINT) AS x, CAST(floor(b + 0.5) AS BIGINT) AS y, CAST(floor(c - a + 0.5) AS BIGINT) AS w, CAST(floor(d - b + 0.5) AS BIGINT) AS h FROM (SELECT ord, greatest(0.0, least(1280.0, (x - 0) / 0.5)) AS a, greatest(0.0, least(800.0, (y - 120) / 0.5)) AS b, greatest(0.0, least(1280.0, (x + w - 0) / 0.5)) AS c, greatest(0.0, least(800.0, (y + h - 120) / 0.5)) AS d FROM {_B} AS q) AS t")
def to_image_box(spark, sf_dir):
    fit = G.letterbox(F.lit(1280), F.lit(800), 640)
    return _boxed(sql(spark, sf_dir, BOXES)).select("ord", G.image_box(F.col("bbox"), fit, F.lit(1280), F.lit(800)).alias("b")).select("ord", "b.*")


# -- text

#: Pairs of whole texts, in ASCII as DuckDB's distance counts bytes: another item, or the same one misread.
_TWO = """SELECT a.item_id AS a_id, b.item_id AS b_id, regexp_replace(a.text, '[^ -~]', '?', 'g') AS a, regexp_replace(CASE WHEN a.item_id % 2 = 0 THEN b.text ELSE replace(replace(a.text, 'e', ''), 'st', ' 5t') END, '[^ -~]', '?', 'g') AS b
    FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id * 7 + 3) % (SELECT count(*) FROM benchmark)"""


def _two(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark")
    b = a.select(F.col("item_id").alias("b_id"), F.col("text").alias("tb"))
    other = F.when(F.col("item_id") % 2 == 0, F.col("tb")).otherwise(F.replace(F.replace("text", F.lit("e"), F.lit("")), F.lit("st"), F.lit(" 5t")))
    ascii = lambda x: F.regexp_replace(x, "[^ -~]", "?")
    pairs = a.join(b, F.col("b_id") == (F.col("item_id") * 7 + 3) % a.count())
    return pairs.select(F.col("item_id").alias("a_id"), "b_id", ascii(F.col("text")).alias("a"), ascii(other).alias("b"))


@query("edit_distance", f"SELECT a_id, b_id, CAST(damerau AS INT) AS d FROM (SELECT a_id, b_id, levenshtein(a, b) AS damerau FROM ({_TWO}) AS t) AS u")
def edit_distance(spark, sf_dir):
    return _two(spark, sf_dir).select("a_id", "b_id", T.edit_distance(F.col("a"), F.col("b")).alias("d"))


_NORM = "trim(regexp_replace({0}, '[ \\t\\n\\r]+', ' ', 'g'))"


@query("char_accuracy", f"SELECT a_id, b_id, round(CASE WHEN length(y) = 0 THEN (CASE WHEN length(x) = 0 THEN 1 ELSE 0 END) ELSE greatest(0, 1 - levenshtein(x, y) / CAST(length(y) AS DOUBLE)) END, 6) AS accuracy FROM (SELECT a_id, b_id, {_NORM.format('a')} AS x, {_NORM.format('b')} AS y FROM ({_TWO}) AS t) AS u")
def char_accuracy(spark, sf_dir):
    return _two(spark, sf_dir).select("a_id", "b_id", F.round(T.char_accuracy(F.col("a"), F.col("b")), 6).alias("accuracy"))


@query("char_accuracy_eval", f"SELECT a_id, b_id, round(CASE WHEN length(b) = 0 THEN 1 ELSE greatest(0, 1 - levenshtein(a, b) / CAST(length(b) AS DOUBLE)) END, 6) AS accuracy FROM ({_TWO}) AS t")
def char_accuracy_eval(spark, sf_dir):
    return _two(spark, sf_dir).select("a_id", "b_id", F.round(T.char_accuracy_eval(F.col("a"), F.col("b")), 6).alias("accuracy"))


@query("agg_ocr_mean", f"SELECT round(avg(greatest(0, 1 - levenshtein(a, b) / CAST(length(b) AS DOUBLE))), 6) AS mean FROM ({_TWO}) AS t")
def agg_ocr_mean(spark, sf_dir):
    return _two(spark, sf_dir).agg(F.round(F.avg(T.char_accuracy_eval(F.col("a"), F.col("b"))), 6).alias("mean"))


@query("normalize_ws", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS h FROM documents")
def normalize_ws(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_ws(F.col("text")).cast("binary")).alias("h"))


@query("name_agreement", f"SELECT a_id, b_id, (length(x) > 0 AND length(y) > 0 AND (contains(x, y) OR contains(y, x))) AS ok FROM (SELECT a_id, b_id, lower({_NORM.format('a')}) AS x, lower({_NORM.format('substr(a, 1, CAST(b_id % 5 * 9 AS BIGINT))')}) AS y FROM ({_TWO}) AS t) AS u")
def name_agreement(spark, sf_dir):
    return _two(spark, sf_dir).select("a_id", "b_id", T.name_agreement(F.col("a"), F.expr("substring(a, 1, CAST(b_id % 5 * 9 AS INT))")).alias("ok"))


@query("windowed", "SELECT doc_id, CASE WHEN p > 0 THEN substr(text, CAST(greatest(0, p - 1 - 200) + 1 AS BIGINT), CAST(least(length(text), p - 1 + 5 + 200) - greatest(0, p - 1 - 200) AS BIGINT)) END AS win, CAST(CASE WHEN p > 0 THEN p - 1 - greatest(0, p - 1 - 200) END AS INT) AS at FROM (SELECT doc_id, text, strpos(text, ' the ') AS p FROM documents) AS t")
def windowed(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents").select("doc_id", T.windowed(F.col("text"), F.lit(" the ")).alias("w"))
    return rows.select("doc_id", F.col("w.window").alias("win"), F.col("w.start").alias("at"))


@query("prng_lcg", "SELECT event_id, (event_id * 1664525 + 1013904223) & 4294967295 AS state FROM events")
def prng_lcg(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.lcg(F.col("event_id")).alias("state"))


@query("hash_fnv1a", """WITH RECURSIVE r AS (SELECT event_id, props, 0 AS i, CAST(2166136261 AS BIGINT) AS h FROM (SELECT min(event_id) AS event_id, props FROM events GROUP BY props) AS t UNION ALL
    SELECT event_id, props, i + 1, (xor(h, ord(substr(props, CAST(i + 1 AS BIGINT), 1))) * 16777619) & 4294967295 FROM r WHERE i < length(props)) SELECT event_id, h FROM r WHERE i = length(props)""")
def hash_fnv1a(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("props").agg(F.min("event_id").alias("event_id"))
    return rows.select("event_id", T.fnv1a(F.col("props")).alias("h"))


@query("parse_observe", "SELECT event_id, CAST(event_id % 7 AS INT) AS regions, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 900 END AS INT) AS ms FROM events")
def parse_observe(spark, sf_dir):
    line = F.concat(F.lit("vision read "), (F.col("event_id") % 7).cast("string"), F.lit(" region(s)"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(" in "), (F.col("event_id") % 900).cast("string"), F.lit(" ms"))))
    return table(spark, sf_dir, "events").select("event_id", T.parse_observe(line).alias("o")).select("event_id", "o.*")
