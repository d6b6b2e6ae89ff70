"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows that are dealt into one partition, about.
ROWS_TOGETHER = 500_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written there and read again: what follows starts from it, also after losing executors."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for shuffles whose small rows become large ones behind them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(rows: DataFrame) -> int:
    """The session's number of shuffle partitions, or more where each would have more than ``ROWS_TOGETHER`` of these rows.

    Counts the rows, so they should be those of a table as it is stored, whose files tell their number.
    """
    return max(shuffle_partitions(rows.sparkSession), -(-rows.count() // ROWS_TOGETHER))


def dealt(frame: DataFrame, *keys: str, table: DataFrame) -> DataFrame:
    """The rows dealt by keys with few rows each into partitions that the rows of the ``table`` they come from call for.

    Adaptive execution puts partitions together by their compressed size, and ids take ten times that in memory. It leaves a
    given number alone; joins and distincts by the same keys that follow need no shuffle of their own.
    """
    return frame.repartition(partitions_for(table), *keys)
