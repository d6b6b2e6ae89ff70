"""Trees of any depth (O-52, O-58, O-62c, O-64h): closure by pointer jumping, interval labels, rollups, cycle check.

Every round doubles the length of the pointers, so a tree of depth d takes log2(d) joins. Nodes whose parent is not among
the nodes are roots. A node that is its own ancestor has pointers that never end; that is found and refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightlines.sources.shared import stored


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of (node, parent) rows, each node being its own ancestor at distance 0.

    A node has one row; null nodes are left out. Raises ``ValueError`` where nodes form a cycle. Runs jobs.
    """
    known = stored(nodes.where("node IS NOT NULL").select("node", "parent"), "nodes")
    n = known.count()
    if known.select("node").distinct().count() < n:
        raise ValueError("a node has two rows")
    pointers = known.join(known.selectExpr("node AS parent"), "parent", "left_semi").select("node", "parent")
    pairs = known.selectExpr("node AS ancestor", "node AS descendant", "0L AS distance")
    step = 1
    while True:
        pointers = stored(pointers, "pointers")
        if pointers.isEmpty():
            return pairs
        if step > n:
            inside = sorted(str(r.node) for r in pointers.select("node").limit(5).collect())
            raise ValueError(f"a cycle is above {', '.join(inside)}")
        further = pairs.join(pointers, F.expr("ancestor = node")).selectExpr(
            "parent AS ancestor", "descendant", f"distance + {step}L AS distance"
        )
        pairs = stored(pairs.unionByName(further), "closure")
        twice = pointers.selectExpr("node AS parent", "parent AS grandparent")
        pointers = pointers.join(twice, "parent").selectExpr("node", "grandparent AS parent")
        step *= 2


def labels(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, first, last): what lies below a node has its ``first`` in the node's interval, and nothing else has.

    ``pairs`` is the closure of ``nodes``. Siblings, and roots, go by name; those of one parent are numbered by one sort.
    """
    sizes = pairs.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("size"))
    parents = pairs.where("distance = 1").selectExpr("descendant AS node", "ancestor AS above")
    placed = nodes.where("node IS NOT NULL").select("node").join(sizes, "node").join(parents, "node", "left")
    earlier = Window.partitionBy("above").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.when(F.col("above").isNull(), 0).otherwise(1)
    placed = placed.select("node", "size", offset.alias("offset"))
    # a node's place is the sum of the offsets on its way from the root
    first = (
        pairs.join(placed.selectExpr("node AS ancestor", "offset"), "ancestor")
        .groupBy(F.col("descendant").alias("node")).agg(F.sum("offset").alias("first"))
    )
    return first.join(placed, "node").selectExpr("node", "first", "first + size - 1 AS last")


def rolled_up(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, n): counts of nodes (node, n) summed over all that lies below each; nodes without any are left out.

    Sums are pre-aggregated before the shuffle, so a root above everything is no hot group.
    """
    below = pairs.join(counts.selectExpr("node AS descendant", "n"), "descendant")
    return below.groupBy(F.col("ancestor").alias("node")).agg(F.sum("n").alias("n"))
