"""URL filters: a trie over reversed host labels, then path segments.

A rule is (host, path, block?) and fits a URL whose host is the rule's host or a
subdomain of it and whose path starts with the rule's path.  One walk down the
labels from the right, then along the segments, meets every rule that fits; the
one that is met last is the longest: more host labels first, then a longer path.
Of an allow and a block rule for the same place, block wins.

Up to ``MAX_RULES`` rules, which are counted first, are one trie that is
broadcast, and judging is one narrow pass.  More rules are parted by the last two
labels of their hosts (those of one label by that) into tries of about as many
rules; URLs meet the trie of their own site, and then that of their last label if
no rule of the site fits.  Tries with many URLs are copied to as many tasks as
``URLS`` asks for, so a host with a third of all URLs is no single task's work.
A task holds one trie - the rules of one site, if that has more than MAX_RULES -
and ``URLS`` URLs.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  A null URL, or one
without ``://``, has an empty host and path and gets the default verdict, like
every URL that no rule fits.  Repeated rows are judged alike, an empty table
gives an empty result and an empty rule list the default; null rule hosts or
paths fit nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import persist

MAX_RULES = 200_000
#: URLs that meet one copy of a trie, about.
URLS = 100_000
ALLOW, BLOCK = "allow", "block"


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Trie:
    """Nodes are dicts: child labels or segments by name, ``PATHS`` the root of the paths, ``TAILS`` rules that end in or behind this segment."""

    PATHS, TAILS = 0, 1

    def __init__(self, rules: Iterable[tuple[str | None, str | None, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            if host is None or path is None:
                continue
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            tails = node.setdefault(self.TAILS, {})
            old = tails.get(tail)
            if old is None or verdict == BLOCK:
                tails[tail] = (f"{host}{path}", verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if self.PATHS in node:
                best = self._path(node[self.PATHS], path) or best
        return best

    def _path(self, node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            tails = node.get(self.TAILS)
            if tails:
                # Rules that end here: the longest start of this segment.
                for n in range(len(segment), -1, -1):
                    if segment[:n] in tails:
                        best = tails[segment[:n]]
                        break
            node = node.get(segment)
            if node is None:
                break
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """One row a row of ``pages``: page_id, host, path, rule, verdict. ``rules``: (host, path, allow or block)."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = dict(urls.dtypes)["page_id"]
    if isinstance(rules, DataFrame):
        table = rules.toDF("host", "path", "verdict")
        if table.limit(max_rules + 1).count() > max_rules:
            return _parted(urls, table, default, max_rules)
        rules = [tuple(x) for x in table.collect()]
    elif len(rules) > max_rules:
        return _parted(urls, spark.createDataFrame(rules, "host string, path string, verdict string"), default, max_rules)
    trie = spark.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [parts(x) for x in batch.column(1).to_pylist()]
            found = [trie.value.find(*x) for x in cut]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in cut], pa.string()), pa.array([x[1] for x in cut], pa.string()), pa.array([x[0] if x else None for x in found], pa.string()), pa.array([x[1] if x else default for x in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _parted(urls: DataFrame, rules: DataFrame, default: str, max_rules: int) -> DataFrame:
    """The same for a rule set of any size: tries by site, then by last label."""
    kind = dict(urls.dtypes)["page_id"]
    schema = f"page_id {kind}, host string, path string, rule string, verdict string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [parts(x) for x in batch.column(1).to_pylist()]
            none = pa.nulls(len(batch), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in both], pa.string()), pa.array([x for _, x in both], pa.string()), none, none], ["page_id", "host", "path", "rule", "verdict"])

    rules = persist(rules.where("host IS NOT NULL AND path IS NOT NULL"), "rules")
    out = persist(urls.mapInArrow(cut, schema), "urls")
    single = F.instr("host", ".") == 0
    for labels, own in ((2, rules.where(~single)), (1, rules.where(single))):
        out = persist(_met(out, own, labels, max_rules, schema), "urls")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _met(urls: DataFrame, rules: DataFrame, labels: int, max_rules: int, schema: str) -> DataFrame:
    """URLs without a rule yet get the one that fits best of the trie of their last ``labels`` labels."""
    tries = max(1, -(-rules.count() // max_rules))
    key = F.substring_index(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), ".", -labels)
    number = F.pmod(F.xxhash64(key), F.lit(tries)).cast("long")
    urls = urls.withColumn("trie", number)
    # A row a trie, and these are far fewer than the rules.
    sizes = urls.groupBy("trie").count().select("trie", F.ceil(F.col("count") / URLS).cast("long").alias("copies"))
    copies = {r["trie"]: r["copies"] for r in sizes.collect()}
    table = F.broadcast(urls.sparkSession.createDataFrame(list(copies.items()), "trie long, copies long"))
    # The table was written, so rows have the same numbers if a task is lost.
    dealt = urls.join(table, "trie").withColumn("copy", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "copies")).drop("copies")
    ruled = rules.withColumn("trie", number).join(table, "trie").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key, urls, rules):
        trie = Trie(zip(*(rules[c].to_pylist() for c in ("host", "path", "verdict")), strict=True))
        rows = list(zip(*(urls[c].to_pylist() for c in ("host", "path", "rule", "verdict")), strict=True))
        found = [(rule, verdict) if rule is not None else trie.find(host, path) or (None, None) for host, path, rule, verdict in rows]
        out = urls.select(names[:3])
        return out.append_column("rule", pa.array([x for x, _ in found], pa.string())).append_column("verdict", pa.array([x for _, x in found], pa.string()))

    return dealt.groupBy("trie", "copy").cogroup(ruled.groupBy("trie", "copy")).applyInArrow(run, schema)
