"""Typed interface elements and visual regions from HTML.

Markup is parsed batch by batch in Python (the JVM's ``xpath`` refuses real
pages).  Credential fields are dropped inside the parser, before their
attributes reach a column.  Static markup has no layout: a box comes from
``data-x``, ``data-y`` and the ``width``/``height`` attributes or inline style,
else it is a 100 by 20 line at its place in the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.pii import SPACE
from maskwright.operators.context import CREDENTIAL_AUTOCOMPLETE, CREDENTIAL_TYPES

# Elements without an end tag, elements without visible text, painted elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(["script", "style", "noscript", "template"])
VISUAL = frozenset("canvas video svg img picture iframe".split())
FIELDS = frozenset(["input", "textarea"])
MIN_SIDE = 32
VIEWPORT = (1280, 800)
ELEMENT = "struct<id:string,ord:int,tag:string,role:string,text:string,aria_label:string,bbox:struct<x:int,y:int,w:int,h:int>,source:string,sensitive:boolean>"
REGION = "struct<id:string,role:string,described_text:string,bbox:struct<x:int,y:int,w:int,h:int>>"
_SPACE = re.compile(SPACE + "+")


def _number(text: str | None) -> float | None:
    m = re.match(r"\s*(-?\d+(?:\.\d+)?)", text or "")
    return float(m[1]) if m else None


class Node:
    __slots__ = ("tag", "at", "parent", "parts", "place")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, place: int):
        self.tag, self.at, self.parent, self.parts, self.place = tag, attrs, parent, [], place

    def has(self, name: str) -> bool:
        return name in self.at

    def get(self, name: str) -> str:
        return self.at.get(name) or ""

    def style(self, name: str) -> str:
        m = re.search(rf"(?:^|;)\s*{name}\s*:\s*([^;]+)", self.get("style"), re.I)
        return m[1].strip().lower() if m else ""

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()

    def hidden(self) -> bool:
        node = self
        while node:
            if node.has("hidden") or node.style("display") == "none" or node.style("visibility") == "hidden":
                return True
            node = node.parent
        return self.get("aria-hidden") == "true"

    def box(self) -> tuple[float, float, float, float]:
        size = [_number(self.style(k)) if self.style(k) else _number(self.get(k)) for k in ("width", "height")]
        x, y = _number(self.get("data-x")), _number(self.get("data-y"))
        return x or 0, self.place * 20 if y is None else y, 100 if size[0] is None else size[0], 20 if size[1] is None else size[1]


class Page(HTMLParser):
    """A flat list of a page's nodes in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[Node] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(reversed(attrs)), self.open[-1] if self.open else None, len(self.nodes))
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not any(n.tag in SILENT for n in self.open):
            for n in self.open:
                if n.tag == "label" or interactive(n):
                    n.parts.append(data)


def interactive(n: Node) -> bool:
    return (n.tag == "a" and n.has("href")) or n.tag in ("button", "input", "select", "textarea") or n.has("role") or n.get("contenteditable") == "true" or (n.has("tabindex") and n.get("tabindex") != "-1")


def credential(n: Node) -> bool:
    """Fields whose value must never be read; pages mark others with ``data-<name>-sensitive="true"``."""
    return n.get("autocomplete").lower().strip() in CREDENTIAL_AUTOCOMPLETE or (n.tag == "input" and n.get("type").lower() in CREDENTIAL_TYPES) or any(k.startswith("data-") and k.endswith("-sensitive") and v == "true" for k, v in n.at.items())


def _half_up(x: float) -> int:
    return int((x + 0.5) // 1)


def elements(html: str) -> list[dict]:
    """Perceivable interactive elements that are no credential fields."""
    page = Page(html)
    labels = {n.get("for"): n for n in reversed(page.nodes) if n.tag == "label" and n.get("for")}
    out: list[dict] = []
    for n in page.nodes:
        if not interactive(n) or credential(n) or n.hidden():
            continue
        x, y, w, h = map(_half_up, n.box())
        if w <= 0 or h <= 0:
            continue
        kind, aria = n.get("type").lower(), n.get("aria-label").strip()
        role = n.get("role") or ((kind if kind in ("checkbox", "radio") else "text_field") if n.tag == "input" else {"a": "link", "button": "button", "select": "combobox", "textarea": "text_field"}.get(n.tag, "interactive"))
        if aria:
            text = aria
        elif n.tag in FIELDS:
            label = labels.get(n.get("id")) if n.get("id") else None
            up = n.parent
            while label is None and up:
                label, up = (up if up.tag == "label" else None), up.parent
            text = (label.text() if label else "") or n.get("placeholder") or n.get("name")
        else:
            text = n.text()
        out.append({"id": f"dom_{len(out) + 1}", "ord": len(out) + 1, "tag": n.tag, "role": role, "text": text, "aria_label": aria or None, "bbox": {"x": x, "y": y, "w": w, "h": h}, "source": "dom", "sensitive": False})
    return out


def regions(html: str, viewport: tuple[int, int] = VIEWPORT) -> list[dict]:
    """Visible painted regions of 32 pixels or more each side, clipped to the viewport."""
    out: list[dict] = []
    for n in Page(html).nodes:
        if n.tag not in VISUAL or n.hidden() or n.style("opacity") == "0":
            continue
        x, y, w, h = n.box()
        if w < MIN_SIDE or h < MIN_SIDE or x + w <= 0 or y + h <= 0 or x >= viewport[0] or y >= viewport[1]:
            continue
        left, top = max(0, _half_up(x)), max(0, _half_up(y))
        told = n.get("alt").strip() or n.get("aria-label").strip() or n.get("title").strip()
        out.append({"id": f"vision_{len(out) + 1}", "role": n.tag, "described_text": told, "bbox": {"x": left, "y": top, "w": _half_up(min(x + w, viewport[0]) - left), "h": _half_up(min(y + h, viewport[1]) - top)}})
    return out


def _parsed(of, kind: str, name: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, _parse_datatype_string

    arrow = to_arrow_type(ArrayType(_parse_datatype_string(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(x) if x else [] for x in batch.column(1).to_pylist()], arrow)], ["screen_id", name])

    return run


def attributes(html: Column, tag: str, name: str) -> Column:
    """The values of an attribute of all elements of a tag, in document order; those without it, or without a value, give none."""

    @F.arrow_udf("array<string>")
    def run(pages: pa.Array) -> pa.Array:
        values = lambda x: [v for n in Page(x).nodes if n.tag == tag and n.has(name) and (v := n.get(name)) is not None]
        return pa.array([None if x is None else values(x) for x in pages.to_pylist()], pa.list_(pa.string()))

    return run(html)


def scan_dom(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row an element: screen_id, id, ord, tag, role, text, aria_label, bbox, source, sensitive."""
    rows = pages.select(F.col(id_col).alias("screen_id"), html_col)
    kind = dict(rows.dtypes)["screen_id"]
    found = rows.mapInArrow(_parsed(elements, ELEMENT, "e"), f"screen_id {kind}, e array<{ELEMENT}>")
    return found.select("screen_id", F.explode("e").alias("e")).select("screen_id", "e.*")


def scan_visual_regions(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a region: screen_id, id, role, described_text, bbox."""
    rows = pages.select(F.col(id_col).alias("screen_id"), html_col)
    kind = dict(rows.dtypes)["screen_id"]
    found = rows.mapInArrow(_parsed(regions, REGION, "r"), f"screen_id {kind}, r array<{REGION}>")
    return found.select("screen_id", F.explode("r").alias("r")).select("screen_id", "r.*")


# Challenge artifacts in order - elements, frame sources, titles of interstitial pages.
_WIDGET = r'(?i)<(?=[^>]*class\s*=\s*"[^"]*{0}[^"]*")(?=[^>]*data-sitekey)[^>]*>'
_ID = r'(?i)<[^>]*\bid\s*=\s*"(?:{0})"'
CHALLENGES = [
    ("recaptcha", _WIDGET.format("g-recaptcha") + "|" + _ID.format("recaptcha-anchor")),
    ("hcaptcha", _WIDGET.format("h-captcha")),
    ("turnstile", _WIDGET.format("cf-turnstile")),
    ("cloudflare-challenge", _ID.format("challenge-form|challenge-running|cf-challenge-running")),
    ("akamai-challenge", _ID.format("sec-cpt-if") + r'|<iframe[^>]*\bsrc\s*=\s*"[^"]*akamai'),
    ("px-challenge", _ID.format("px-captcha")),
]
_FRAME = r'(?i)<iframe[^>]*\bsrc\s*=\s*"[^"]*(?:{0})'
FRAMES = [
    ("recaptcha", _FRAME.format(r"google\.com/recaptcha|recaptcha\.net")),
    ("hcaptcha", _FRAME.format(r"hcaptcha\.com")),
    ("turnstile", _FRAME.format(r"challenges\.cloudflare\.com")),
    ("arkose", _FRAME.format(r"(?:arkoselabs|funcaptcha)\.com")),
]
TITLES = [
    ("cloudflare-interstitial", "(?i)just a moment|attention required|checking your browser"),
    ("generic-interstitial", "(?i)verify you are (?:a )?human|are you a robot"),
    ("rate-interstitial", "(?i)unusual traffic|access denied.*automated"),
]


def visible_text(html: Column) -> Column:
    """Text of the body without markup."""
    body = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", "")
    bare = F.regexp_replace(body, r"(?is)<(script|style|noscript)\b.*?</\1>", "")
    return F.trim(F.regexp_replace(bare, "<[^>]*>", ""))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def bot_marker(html: Column) -> Column:
    """The first challenge marker of a page; null if there is none.

    Titles only count on pages that are mostly challenge: under 2,000 characters
    of text and 400 elements.
    """
    head = title(html)
    small = (F.length(visible_text(html)) < 2000) & (F.regexp_count(html, F.lit("<[a-zA-Z]")) < 400)
    return F.coalesce(*[F.when(html.rlike(p), m) for m, p in CHALLENGES + FRAMES], *[F.when(small & head.rlike(p), m) for m, p in TITLES])


def frozen(html: Column) -> Column:
    """Markup without active content: scripts, frames, objects, preloads, refreshes, media and remote URLs in styles."""
    out = F.regexp_replace(html, r"(?is)<(script|noscript|iframe|object|video|audio)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?is)<(?:embed|base|source)\b[^>]*>|<meta\b[^>]*http-equiv[^>]*>|<link\b[^>]*rel\s*=\s*[\"']?(?:preload|prefetch|modulepreload|preconnect|dns-prefetch)[^>]*>", "")
    return F.regexp_replace(out, r"(?i)url\(\s*[\"']?(?!data:)[^)]*\)", "none")
