"""Context, risk, loop, HTML, validation and evaluation on small inputs."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import actions as A
from maskwright.functions import contract, verifier
from maskwright.functions import geometry as G
from maskwright.operators import context as C
from maskwright.operators import loop as L
from maskwright.sources import html as H
from maskwright.sources import readers
from maskwright.streaming.task_loop import task_loop


def elements(spark, rows):
    return spark.createDataFrame([(1, i, r, t, s, (0, 0, 10, 10)) for i, (r, t, s) in enumerate(rows)], "screen_id int, ord int, role string, text string, sensitive boolean, bbox struct<x:int,y:int,w:int,h:int>")


def test_marks_start_after_a_sensitive_element(spark):
    rows = elements(spark, [("button", "Secret", True), ("button", "Go", False), ("heading", "About it", False), ("heading", "The report", False)])
    got = C.marked(rows, F.lit("open the report")).orderBy("mark").collect()
    assert [(r.mark_id, r.text) for r in got] == [("M1", "Go"), ("M2", "The report")]


def test_duplicate_boxes_fuse(spark):
    box = "screen_id int, id string, bbox struct<x:int,y:int,w:int,h:int>"
    dom = spark.createDataFrame([(1, "d", (0, 0, 100, 30))], box)
    vision = spark.createDataFrame([(1, "v", (2, 1, 98, 29)), (1, "w", (200, 0, 50, 50)), (2, "x", (0, 0, 100, 30))], box)
    assert sorted(r.id for r in C.fused(dom, vision).collect()) == ["d", "w", "x"]


RISKS = [("click", 0.9, False, "low"), ("click", 0.7, False, "medium"), ("click", 0.4, False, "high"), ("type", 0.9, False, "low"), ("type", 0.9, True, "high"), ("navigate", 1.0, False, "high"), ("none", 0.0, True, "low"), ("done", 0.1, True, "low"), ("blocked", 0.0, False, "low"), ("scroll", 0.75, False, "low"), ("click", 0.5, False, "medium")]


def test_risk_table(spark):
    rows = spark.createDataFrame(RISKS, "action string, confidence double, sensitive boolean, want string")
    got = rows.select("want", A.local_risk(F.col("action"), F.col("confidence"), F.col("sensitive")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_reasoner(spark):
    e = C.context(elements(spark, [("text_field", "report", False), ("link", "Report, final", False), ("button", "Download report", False)]), F.lit("report"))
    ask = lambda task, past: C.deterministic(e, F.lit(task), F.array(*map(F.lit, past)).cast("array<string>")).first()
    assert (ask("the report", []).target_id, ask("the report", []).action) == ("M3", "click")
    assert ask("a b", []).target_id == "M2"
    assert ask("nothing fits", []).action == "none"
    assert ask("the report", ["executed click"]).action == "done"


def test_prompt(spark):
    e = F.array(F.struct(F.lit("M1").alias("mark_id"), F.lit("link").alias("role"), F.lit(" it's ").alias("text"), F.array(*map(F.lit, (1, 2, 3, 4))).alias("bbox")))
    h = F.array(F.struct(F.lit("click").alias("action"), F.lit("link").alias("target_role"), F.lit("executed click").alias("outcome"), F.lit("Home").alias("page_ident")))
    got = spark.range(1).select(C.prompt(F.lit("t"), F.lit(2), F.lit(15), F.lit("Say \"x\" & 'y'"), h, e).alias("p")).first().p
    assert got == "Task: t\nStep 2 of at most 15.\nCurrent page title: 'Say \"x\" & \\'y\\''\n\nPrevious steps:\n1. click on a link -> executed click [page: Home]\n\nElements:\n- M1 [link] \"it's\" at (1, 2, 3, 4)\n\nAnswer with the JSON action."


STEPS = {
    "a": ["executed", "none", "executed", "none", "none", "executed"],
    "b": ["executed"] * 20,
    "c": ["executed", "done", "executed"],
    "d": ["executed"],
    "e": ["none", "blocked"],
    "f": ["failed"],
}
ENDS = {"a": ("no_progress", 5), "b": ("budget_exhausted", 15), "c": ("done", 2), "e": ("blocked", 2), "f": ("failed", 1)}


def _streamed_loop(spark, parts, tmp_path, **options):
    """Status and steps by task, of lists of (task, step, state, minute) that come one after the other."""
    schema = "task_id string, step int, state string, ts timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        rows = spark.createDataFrame([(t, n, s, m) for t, n, s, m in part], "task_id string, step int, state string, m int")
        rows.select("task_id", "step", "state", F.timestamp_seconds(1_700_000_000 + F.col("m") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = task_loop(stream, **options).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return [(r.task_id, r.status, r.steps) for r in spark.read.schema("task_id string, status string, steps int").parquet(out).collect()], query


END = [("end", 1, "executed", 100_000)]


def test_loop_batch_and_stream_agree(spark, tmp_path):
    reports = [(t, i, s) for t, ss in STEPS.items() for i, s in enumerate(ss, 1)]
    batch = {r.task_id: (r.status, r.steps) for r in L.finished(spark.createDataFrame(reports, "task_id string, step int, state string")).collect()}
    assert batch == ENDS | {"d": ("running", 1)}
    timed = [(t, i, s, i) for t, i, s in reports]
    got, _ = _streamed_loop(spark, [timed[1::2] + timed[:4], timed[::2], END], tmp_path)  # some twice, none in order
    assert sorted(got) == sorted((t, *x) for t, x in ENDS.items())


def test_stream_takes_steps_in_their_order(spark, tmp_path):
    """A later step that comes first waits for the one before it; reports behind the end are ignored; state is freed."""
    parts = [[("x", 3, "done", 3)], [("x", 1, "blocked", 1), ("x", 3, "done", 3)], [("end", 1, "executed", 30)], [("x", 4, "failed", 31)], END, [("end", 2, "executed", 200_000)]]
    got, query = _streamed_loop(spark, parts, tmp_path, forget="1 hour")
    assert got == [("x", "blocked", 1)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_audit_goes_on_from_its_last_number(spark, tmp_path):
    path = str(tmp_path / "audit")
    for k in range(3):
        readers.append_audit(spark.createDataFrame([("t", "act", f"{k}{i}", True) for i in range(3)], "task_id string, stage string, detail string, ok boolean").coalesce(1), path)
    rows = readers.read_audit(spark, path).collect()
    assert [r.detail for r in rows] == [f"{k}{i}" for k in range(3) for i in range(3)] and len({r.seq for r in rows}) == 9


def test_null_pixels(spark):
    from maskwright.functions import pixels

    box = "struct<x:int,y:int,w:int,h:int>"
    rows = spark.createDataFrame([(None, 1, 1, [(0, 0, 1, 1)], (0, 0, 1, 1)), (bytearray(4), None, 1, None, None), (bytearray(4), 1, 1, [None], None), (bytearray(4), 1, 1, [(0, 0, 1, 1)], (0, 0, 1, 1))], f"p binary, w int, h int, bs array<{box}>, b {box}")
    got = rows.select(pixels.masked("p", "w", "h", "bs").alias("m"), pixels.fully_masked("p", "w", "h", "b").alias("f"), pixels.model_input(F.col("p"), F.col("w"), F.col("h"), 2).alias("t")).collect()
    assert [r.m is None for r in got] == [True, True, False, False] and [r.f for r in got] == [None, None, None, False] and [r.t is None for r in got] == [True, True, False, False]


def test_png():
    """Every filter and colour type, against pixels that were filtered by hand."""
    import random
    import struct
    import zlib

    from maskwright.sources import png

    rng = random.Random(2)
    for width, height, colour in [(5, 7, 6), (1, 1, 6), (4, 10, 2), (6, 5, 0)]:
        n = png.CHANNELS[colour]
        rows = [[rng.randrange(256) for _ in range(width * n)] for _ in range(height)]
        lines = bytearray()
        for y, row in enumerate(rows):
            above = rows[y - 1] if y else [0] * len(row)
            kind = y % 5
            lines.append(kind)
            for x, v in enumerate(row):
                a, b, c = row[x - n] if x >= n else 0, above[x], above[x - n] if x >= n else 0
                p = a + b - c
                nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                lines.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) & 255)
        data = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(bytes(lines))) + png._chunk(b"IEND", b"")
        want = b"".join(bytes((*px, 255)) if n == 3 else bytes(px) if n == 4 else bytes((*px * 3, 255)) for row in rows for px in (row[i : i + n] for i in range(0, len(row), n)))
        assert png.decode(data) == (width, height, want)
        assert png.decode(png.encode(want, width, height)) == (width, height, want)
        with pytest.raises(ValueError):
            png.decode(data[:45] + bytes([data[45] ^ 1]) + data[46:])


def test_png_files(spark, tmp_path):
    from maskwright.sources import png

    (tmp_path / "a.png").write_bytes(png.encode(bytes(range(16)), 2, 2))
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.txt").write_bytes(b"text")
    got = png.scan_png(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.width, r.height, bytes(r.rgba)) for r in got] == [("a.png", 2, 2, bytes(range(16)))]
    assert spark.createDataFrame([(None,)], "b binary").select(png.decoded(F.col("b")).alias("i")).first().i is None


def test_numbers_of_a_hot_scope(spark):
    from maskwright.operators.redact import ranked

    rows = [("hot" if i % 3 else f"s{i % 7}", i * 37 % 5000, i) for i in range(5000)]
    got = ranked(spark.createDataFrame(rows, "k string, o int, i int"), ["k"], ["o"], "n").collect()
    want, last = {}, {}
    for k, _, i in sorted(rows, key=lambda r: (r[0], r[1])):
        want[i] = last[k] = last.get(k, 0) + 1
    assert {r.i: r.n for r in got} == want


def test_filled_templates(spark):
    from maskwright.operators.generate import filled

    rows = spark.createDataFrame([("{a} and {b}{a}{none}.", {"a": "é1", "b": "two"}), ("plain", {}), ("", {"a": "x"}), (None, {"a": "x"})], "t string, v map<string,string>")
    got = [r.f for r in rows.select(filled(F.col("t"), F.col("v")).alias("f")).collect()]
    assert got[0].text == "é1 and twoé1." and [got[0].text[s.start : s.end] for s in got[0].spans] == ["é1", "two", "é1"] and [s.type for s in got[0].spans] == ["A", "B", "A"]
    assert got[1].text == "plain" and got[1].spans == [] and got[2].text == "" and got[3] is None


def test_boxes_meet_across_cells(spark):
    import random

    rng = random.Random(5)
    box = lambda: tuple(rng.randrange(-50, 400) for _ in range(2)) + tuple(rng.randrange(0, 200) for _ in range(2))
    schema = "screen_id int, ord int, bbox struct<x:int,y:int,w:int,h:int>"
    a, b = ([(s, i, box()) for s in range(3) for i in range(40)] for _ in range(2))
    got = {(r.screen_id, r.want, r.got): r.iou for r in C.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.2).collect()}
    want = {}
    for s, i, (x, y, w, h) in a:
        for t, j, (p, q, r, u) in b:
            both = max(0, min(x + w, p + r) - max(x, p)) * max(0, min(y + h, q + u) - max(y, q))
            if s == t and both and both / (w * h + r * u - both) >= 0.2:
                want[s, i, j] = both / (w * h + r * u - both)
    assert got == pytest.approx(want)


HTML = """<html><head><title>T</title></head><body><a href="/x"> Home <b>page</b></a><a>no</a><input type="hidden" name="h"><input type="PASSWORD"><input autocomplete="cc-csc">
<label for="q">Search <i>it</i></label><input id="q" value="secret"><label>Agree<input type="checkbox"></label><div style="display:none"><button>gone</button></div>
<button aria-label=" Close ">x</button><span role="tab" tabindex="-1">Tab</span><p tabindex="0">P</p><p tabindex="-1">N</p><select><option>One</option></select>
<textarea name="n">typed</textarea><div data-agent-sensitive="true" role="button">s</div><button style="width:0">w</button></body></html>"""


def test_dom_scan():
    got = [(e["id"], e["role"], e["text"]) for e in H.elements(HTML)]
    assert got == [("dom_1", "link", "Home page"), ("dom_2", "text_field", "Search it"), ("dom_3", "checkbox", "Agree"), ("dom_4", "button", "Close"), ("dom_5", "tab", "Tab"), ("dom_6", "interactive", "P"), ("dom_7", "combobox", "One"), ("dom_8", "text_field", "n")]
    assert "secret" not in str(H.elements(HTML)) and "typed" not in str(H.elements(HTML))


def test_regions_and_clipping():
    html = '<img width=40 height=40 data-x="1260" data-y="790" alt=" A "><svg width=20 height=99></svg><video width=64 height=64 title="V" style="opacity:0"></video><canvas width=32 height=32 data-x=0 data-y=0>'
    assert H.regions(html) == [{"id": "vision_1", "role": "img", "described_text": "A", "bbox": {"x": 1260, "y": 790, "w": 20, "h": 10}}, {"id": "vision_2", "role": "canvas", "described_text": "", "bbox": {"x": 0, "y": 0, "w": 32, "h": 32}}]


def test_dom_scan_on_nulls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<a href=x>y")], "page_id long, html string")
    assert [r.text for r in H.scan_dom(pages).collect()] == ["y"]


def test_bot_markers(spark):
    pages = [('<div class="x g-recaptcha" data-sitekey="1">', "recaptcha"), ('<iframe src="https://challenges.cloudflare.com/a">', "turnstile"), ('<i id="challenge-form">', "cloudflare-challenge"), ("<title>Access denied: automated</title><body>x</body>", "rate-interstitial"), ("<title>Just a moment</title><body>" + "word " * 500, None), ("<p>captcha</p>", None)]
    got = spark.createDataFrame(pages, "html string, want string").select("want", H.bot_marker(F.col("html")).alias("got")).collect()
    assert [r.got for r in got] == [w for _, w in pages]


def test_frozen_page(spark):
    html = '<base href="x"><script>a()</script><p style="background:url(http://x/y.png)">t</p><meta http-equiv="refresh"><link rel=preload href=z><iframe src=q></iframe>'
    assert spark.range(1).select(H.frozen(F.lit(html)).alias("h")).first().h == '<p style="background:none">t</p>'


GOOD = '{"schema_version":"1.1","task":"t","elements":[{"mark_id":"M1","role":"link","text":"","bbox":[0,0,1,1]}],"step":{"n":1,"limit":15},"history":[{"action":"click","target_role":null,"outcome":"executed click","page_ident":""}],"page_ident":"Home"}'


@pytest.mark.parametrize("json,want", [(GOOD, True), (GOOD.replace('"n":1', '"n":51'), False), (GOOD.replace('"Home"', f'"{"x" * 121}"'), False), (GOOD.replace('"task":"t"', '"task":3'), False), (GOOD.replace('"M1"', '"N1"'), False), (GOOD[:-1] + ',"url":"u"}', False), ("[]", False), (None, False)])
def test_context_contract(spark, json, want):
    assert spark.createDataFrame([(json,)], "j string").select(contract.valid_context(F.col("j")).alias("v")).first().v is want


def test_suppression_and_greedy(spark):
    b = lambda x: F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("xywh", x, strict=True)])
    c = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(s).alias("score"), b(x).alias("box")) for i, s, x in [(1, 0.5, (0, 0, 10, 10)), (2, 0.9, (1, 0, 10, 10)), (3, 0.4, (50, 0, 10, 10))]])
    assert [r.id for r in spark.range(1).select(G.suppressed(c).alias("k")).first().k] == [2, 3]
    pairs = spark.createDataFrame([(1, w, g, o) for w, g, o in [(1, 1, 0.6), (1, 2, 0.9), (2, 2, 0.95), (2, 1, 0.7)]], "screen_id int, want int, got int, iou double")
    assert sorted((r.want, r.got) for r in C.matched(pairs).collect()) == [(1, 2), (2, 1)]


def test_word_piece():
    cut = verifier.WordPiece(["[UNK]", "jo", "##se", "##ph", "x", ",", "中"])
    assert [p for p, _, _ in cut("José, 中x zz")] == ["[CLS]", "jo", "##se", ",", "中", "x", "[UNK]", "[SEP]"]


def test_failing_verifier_rejects_nothing(spark):
    rows = spark.createDataFrame([("name: Anita Sharma",)], "text string")

    def broken(window, name):
        raise RuntimeError("no model")

    assert verifier.verified(rows, broken).count() == 1
    assert verifier.verified(rows, lambda w, n: 0.0).count() == 0


def _field(number: int, value) -> bytes:
    """A protobuf field: a varint, or bytes, text or nested fields."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _lookup_model(logits) -> bytes:
    """An ONNX model that gives each token its row of ``logits``."""
    import numpy as np

    shape = lambda *dims: b"".join(_field(1, _field(2, d)) for d in dims)
    value = lambda name, kind, *dims: _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape(*dims))))
    table = np.array(logits, np.float32)
    weights = _field(1, table.shape[0]) + _field(1, table.shape[1]) + _field(2, 1) + _field(8, "table") + _field(9, table.tobytes())
    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "logits") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "g") + _field(5, weights) + _field(11, value("input_ids", 7, "one", "n")) + _field(12, value("logits", 1, "one", "n", "labels"))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def test_token_classifier_verifies_names(spark, tmp_path):
    """A model file that knows one surname as a person: the other candidate is rejected; a wrong pin rejects nothing."""
    pytest.importorskip("onnxruntime")
    import hashlib

    from maskwright.functions.model import TokenClassifier

    vocabulary = ["[UNK]", "[CLS]", "[SEP]", "anita", "sharma", "vikrant", "bhardwaj", "name", ":"]
    logits = [[9.0, 0.0, 0.0]] * len(vocabulary)
    logits[4] = [0.0, 9.0, 0.0]
    data = _lookup_model(logits)
    (tmp_path / "model.onnx").write_bytes(data)
    rows = spark.createDataFrame([("name: Anita Sharma",), ("name: Vikrant Bhardwaj",)], "text string")
    model = TokenClassifier(str(tmp_path / "model.onnx"), vocabulary, hashlib.sha256(data).hexdigest())
    assert model("name: Anita Sharma", "Anita Sharma") > 0.99 > 0.01 > model("name: Vikrant Bhardwaj", "Vikrant Bhardwaj")
    assert [r.value for r in verifier.verified(rows, model).collect()] == ["Anita Sharma"]
    wrong = TokenClassifier(str(tmp_path / "model.onnx"), vocabulary, "0" * 64)
    assert verifier.verified(rows, wrong).count() == 2


def test_reasoning_server(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from maskwright.operators.reason_http import replies

    good = {"action": "none", "confidence": 0.5, "risk": "low", "explanation": "e", "reasoning_trace_id": "t"}

    class Server(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            task = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["task"]
            body = {"ok": json.dumps(good), "odd": "{}"}.get(task, "").encode()
            self.send_response(503 if task == "busy" else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([(i, GOOD.replace('"task":"t"', f'"task":"{t}"')) for i, t in enumerate(("ok", "odd", "busy", "ok"))] + [(9, "{}"), (10, None)], "id int, payload string").coalesce(1)
    try:
        got = {r.id: (r.status, r.code) for r in replies(rows, f"http://127.0.0.1:{server.server_port}/reason").collect()}
    finally:
        server.shutdown()
        server.server_close()
    assert got == {0: (200, None), 1: (200, "invalid_response"), 2: (503, "server_rejected"), 3: (200, None), 9: (None, "invalid_response"), 10: (None, "invalid_response")}
    gone = replies(rows.where("id = 0"), f"http://127.0.0.1:{server.server_port}/reason", timeout=2.0).first()
    assert (gone.status, gone.code) == (None, "server_unreachable")


def test_screen_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"a","elements":[{"oracleId":"o","role":"link","name":"n","bbox":[1,2,3,4]}],\n"pii":[],"texts":[]}')
    (tmp_path / "index.json").write_text('{"version":"1","rows":[{"id":"a","elements":1,"pii":0},{"id":"b"}]}')
    (tmp_path / "sources.json").write_text('{"version":"1"}')
    (tmp_path / "review.json").write_text('{"entries":[{"type":"NAME","value":"x","count":2,"screens":["a"],"verdict":"real"}]}')
    assert [r.id for r in readers.indexed_screens(spark, str(tmp_path)).collect()] == ["a"]
    assert readers.review(spark, str(tmp_path / "review.json")).collect()[0].verdict == "real"


def test_gzipped_page(spark, tmp_path):
    import gzip

    path = tmp_path / "p.html.gz"
    path.write_bytes(gzip.compress(HTML.encode()))
    page = readers.page_file(spark, str(path))
    assert H.scan_dom(page.select(F.lit(1).alias("page_id"), "html")).count() == 8


def test_entry_without_corpus_operators(tmp_path):
    """The rest works when the corpus operators and their pipeline are deleted."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here / "maskwright", tmp_path / "maskwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 100 and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
