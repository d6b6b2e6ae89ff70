"""The request log as a stateful stream: windows of latency cells (O-67)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sightlines import schema
from sightlines.operators.latency import WIDTH, counted


def latency_stream(requests: DataFrame, late: str = "10 minutes", width: str = WIDTH) -> DataFrame:
    """Cells of a streaming request log, a window once it can't change any more.

    Requests that come ``late`` after the newest one may be left out; within that time a replayed request counts once.
    State holds the ids of that time and the cells of open windows.
    """
    kept = requests.where("occurred_at IS NOT NULL AND elapsed_ms IS NOT NULL")
    timed = kept.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late)
    return counted(timed.dropDuplicatesWithinWatermark(["request_id"]), F.col("at"), width)


def start_latency(
    spark: SparkSession, source: str, sink: str, checkpoint: str, late: str = "10 minutes", width: str = WIDTH,
    available_now: bool = True,
) -> StreamingQuery:
    """Append the cells of closed windows of the Parquet folder ``source`` to ``sink``; a restart goes on from the checkpoint,
    which must lie in a folder that the cluster shares."""
    requests = spark.readStream.schema(schema.OCCURRENCE["request_log"]).parquet(source)
    writer = (
        latency_stream(requests, late, width).writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
