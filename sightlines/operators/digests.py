"""Digests that say where a table changed (O-65): order-free, mergeable, rolled up along a tree.

The digest of a set of rows is their number, the sum of one hash of each and the exclusive or of another. It does not
depend on the order of rows, those of two disjoint sets give that of their union, and rows can be taken out again. Nodes of
a tree (areas, say) have the digest of all that lies below them: a changed row changes the nodes on its way to the root and
no others, and a comparison from the root down looks below changed nodes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlines.sources.shared import stored

DIGEST = ("n", "total", "mixed")
_WIDE = "decimal(38,0)"


def digested(rows: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """(node, n, total, mixed): digests of the rows below each node; null columns count as themselves.

    Partial digests are made before the shuffle. Nested and map columns go in as JSON text.
    """
    texts = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in columns]
    first, second = F.xxhash64(*texts), F.xxhash64(F.lit("second"), *texts)
    return rows.groupBy(F.col(node).alias("node")).agg(
        F.count("*").alias("n"), F.sum(first.cast(_WIDE)).cast(_WIDE).alias("total"), F.bit_xor(second).alias("mixed")
    )


def _summed(digests: DataFrame, key: str) -> DataFrame:
    return digests.groupBy(F.col(key).alias("node")).agg(
        F.sum("n").alias("n"), F.sum("total").cast(_WIDE).alias("total"), F.bit_xor("mixed").alias("mixed")
    )


def merged(digests: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Digests after rows came and went; nodes without rows go."""
    every = digests
    if added is not None:
        every = every.unionByName(added)
    if removed is not None:
        # the exclusive or takes out what it put in
        every = every.unionByName(removed.selectExpr("node", "-n AS n", f"CAST(-total AS {_WIDE}) AS total", "mixed"))
    return _summed(every, "node").where("n <> 0")


def along_tree(pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """Digests of all nodes of a closure (ancestor, descendant) from those of the nodes that have rows themselves."""
    return _summed(pairs.join(digests, F.expr("descendant = node")), "ancestor")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, change): nodes whose digests differ, ``added`` and ``removed`` where one side has no rows."""
    old = before.select("node", F.struct(*DIGEST).alias("old"))
    new = after.select("node", F.struct(*DIGEST).alias("new"))
    both = old.join(new, "node", "full").where("NOT (old <=> new)")
    return both.selectExpr("node", "CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change")


def changed_below(before: DataFrame, after: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """The changed nodes from a root down, level by level: of (node, parent) rows, only children of changed nodes are
    compared. Runs a job for each level of the tree that holds a change."""
    level = nodes.where(F.col("node") == root).select("node")
    found = None
    while True:
        here = changed(before.join(level, "node", "left_semi"), after.join(level, "node", "left_semi"))
        here = stored(here, "changed")
        if here.isEmpty():
            return here if found is None else found
        found = here if found is None else found.unionByName(here)
        level = nodes.join(here.selectExpr("node AS parent"), "parent", "left_semi").select("node")
