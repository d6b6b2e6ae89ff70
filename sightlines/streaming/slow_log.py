"""The slow-request log as a stream (O-67)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from sightlines import codes, schema
from sightlines.operators.logs import slow_requests


def start_slow_log(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str | None = None,
    threshold_ms: int = codes.SLOW_REQUEST_MS,
    available_now: bool = True,
) -> StreamingQuery:
    """Append slow requests from the Parquet folder ``source`` to ``sink``.

    ``checkpoint`` defaults to a folder below ``spark.checkpoint.dir``, which the
    cluster shares; the file sink and the checkpoint together give exactly-once
    rows across restarts.
    """
    if checkpoint is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("give a checkpoint folder or set spark.checkpoint.dir")
        checkpoint = f"{shared.rstrip('/')}/slow_log"
    requests = spark.readStream.schema(schema.OCCURRENCE["request_log"]).parquet(source)
    writer = (
        slow_requests(requests, threshold_ms)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
