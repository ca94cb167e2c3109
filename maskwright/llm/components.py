"""Connected components of a table of links, by alternating star contraction.

Each round hangs a node's larger neighbours, then its smaller ones, on the
smallest neighbour; the number of rounds grows with the logarithm of the
diameter.  Links stay distributed, every round is written in the shared folder
and the one before it is deleted.  Minima are pre-aggregated and written before
they meet the links, so both sides of that join are plain shuffles: adaptive
execution splits the partition of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import drop_table, persist


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Replaces the table edges (u, v): u > v. Large: each v' > u goes to u's smallest neighbour; small: each v <= u does."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = persist(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    after = persist(out.where("u > v").distinct(), "links")
    drop_table(least)
    drop_table(edges)
    return after


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link."""
    edges = persist(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        edges = _star(_star(edges, True), False)
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
