"""Connected components of graphs of any size, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.storage import discard, materialise


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node links its larger (or its smaller and its own) neighbours to the least of its neighbourhood. No neighbourhood is collected."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if larger:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for every node of an undirected edge list.

    Large-star and small-star rounds; each round's edges are a table in the shared folder. Null ends are ignored; loops and repeated edges are
    allowed, and a node with nothing but a loop is its own component.
    """
    given = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL"), "links")
    nodes = given.select(F.col("a").alias("node")).union(given.select("b")).distinct()
    now = materialise(given.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        summary = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if summary == before or not summary[0]:
            break
        before = summary
        after = materialise(_stars(_stars(now, True), False), "edges")
        discard(now)
        now = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
