"""Ranks inside groups of any size, without a task that holds a group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .common import drop_stored, stored

#: Rows of one range, at most and (while there are fewer ranges than shuffle partitions) at least.
MOST_ROWS, LEAST_ROWS = 1_000_000, 10_000


def ranked(frame: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The frame with ``rank`` (from 0 inside a group, ascending, nulls first) and ``size`` (rows of the group).

    Rows are dealt into ranges of (group, order); ranges are counted, and a row's rank is what lies before its range
    plus its place inside. Null is a group. Rows that are equal in all order columns are ranked in any order; give a
    last column that tells them apart where a third of all rows may be equal. The frame must be stored, as it is read
    more than once; an empty one gives none.
    """
    n = frame.count()
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, math.ceil(n / MOST_ROWS), min(least, math.ceil(n / LEAST_ROWS)))
    dealt = frame.repartitionByRange(ranges, group, *order).withColumn("range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    counts = dealt.groupBy(F.col(group).alias("of"), F.col("range").alias("in_range")).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("of").orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "of", "in_range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy("of")).alias("size"),
    )
    place = F.row_number().over(Window.partitionBy(group, "range").orderBy(*order))
    out = stored(
        dealt.withColumn("place", place)
        .join(counts, F.expr(f"range = in_range AND {group} <=> of"))
        .select(*frame.columns, F.expr("before + place - 1").alias("rank"), "size"),
        "ranked",
    )
    drop_stored(dealt)
    return out
