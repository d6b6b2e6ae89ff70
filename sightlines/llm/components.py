"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of ``links`` (a, b) is connected with.

    Every round links all neighbours of a node to the smallest of them (large star), then the smaller ones alike
    (small star), until each node is linked to its component's smallest alone. A hub never becomes a group in one
    task: minima are pre-aggregated and joined back. Nulls and self-links are ignored.
    """
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = stored(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "links")
    seen = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop_stored(last)
        state = _state(edges)
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
