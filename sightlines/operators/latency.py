"""Latency of requests by time window (O-67): counts in cells of a fixed logarithmic grid.

A cell holds the latencies whose first four binary digits agree, so a quantile read from cells is at most an eighth below the
exact one. Cells are counts: those of two logs, or of two streams, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = "1 hour"
QUANTILES = (50, 90, 99)


def cell_of(ms: str) -> str:
    """The cell of a latency in whole milliseconds as an SQL expression; negative ones count as zero."""
    bits = f"(length(bin({ms})) - 1)"
    return f"CAST(CASE WHEN {ms} < 0 THEN 0 WHEN {ms} < 8 THEN {ms} ELSE 8 * ({bits} - 2) + (shiftright({ms}, {bits} - 3) & 7) END AS INT)"


def least_of(cell: str) -> str:
    """The smallest latency of a cell."""
    return f"IF({cell} < 8, CAST({cell} AS BIGINT), shiftleft(8L + {cell} % 8, {cell} div 8 - 1))"


def counted(requests: DataFrame, time: Column, width: str = WIDTH) -> DataFrame:
    """(started_at, endpoint, cell, n) of requests with a time; ``time`` is their timestamp, batch or stream alike."""
    window = F.window(time, width).alias("w")
    cells = requests.withColumn("cell", F.expr(cell_of("elapsed_ms"))).groupBy(window, "endpoint", "cell")
    return cells.agg(F.count("*").alias("n")).selectExpr("CAST(w.start AS TIMESTAMP_NTZ) AS started_at", "endpoint", "cell", "n")


def latency_cells(requests: DataFrame, width: str = WIDTH) -> DataFrame:
    """Cells of a log; a request that was written twice counts once, those without time or latency not at all."""
    kept = requests.where("occurred_at IS NOT NULL AND elapsed_ms IS NOT NULL").dropDuplicates(["request_id"])
    return counted(kept, F.col("occurred_at").cast("timestamp"), width)


def merged_cells(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("started_at", "endpoint", "cell").agg(F.sum("n").alias("n"))


def quantiles(cells: DataFrame, percents: tuple[int, ...] = QUANTILES) -> DataFrame:
    """(started_at, endpoint, n, p50, ...): the smallest latency of the cell in which each quantile lies.

    A group has a cell for each eighth of a power of two at most, some hundreds of rows, however many requests it has.
    """
    merged = merged_cells(cells)
    group = Window.partitionBy("started_at", "endpoint")
    below = F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    placed = merged.withColumns({"upto": below, "total": F.sum("n").over(group)})
    found = [F.expr(f"min(IF(100 * upto >= {p} * total, {least_of('cell')}, NULL))").alias(f"p{p}") for p in percents]
    return placed.groupBy("started_at", "endpoint").agg(F.sum("n").alias("n"), *found)
