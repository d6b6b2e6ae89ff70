"""Change detection, export history and the slow-request log (O-65 .. O-67)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlines import codes


def fingerprint(counts: DataFrame) -> DataFrame:
    """O-65: a quoted MD5 over the JSON of an area-count table, in fid order (T-14).

    The input has one row per area, so it is dimension-sized.
    """
    row = F.struct(F.col("fid").alias("Fid"), F.col("observation_count").alias("ObservationCount"))
    document = F.to_json(F.sort_array(F.collect_list(row)))
    return counts.agg(F.concat(F.lit('"'), F.md5(document), F.lit('"')).alias("etag"))


def newest_per_user(jobs: DataFrame, rows: int = codes.EXPORT_HISTORY_ROWS) -> DataFrame:
    """O-66: the newest jobs of every user; ties by job id."""
    newest_first = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.withColumn("_rank", F.row_number().over(newest_first)).where(F.col("_rank") <= rows).drop("_rank")


def history(jobs: DataFrame, user_id: str, rows: int = codes.EXPORT_HISTORY_ROWS) -> DataFrame:
    """O-66 for one user."""
    return jobs.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("job_id")).limit(rows)


def expired_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """O-66: jobs whose files may go: complete and expired, or failed or cancelled over a day ago with files."""
    expired = (F.col("status") == codes.JOB_COMPLETE) & (F.col("expires_at") < now)
    has_files = F.col("blob_path").isNotNull() | F.col("excel_blob_path").isNotNull()
    abandoned = (
        F.col("status").isin(codes.JOB_FAILED, codes.JOB_CANCELLED)
        & has_files
        & (F.col("completed_at") < now - F.expr("INTERVAL 1 DAY"))
    )
    return jobs.where(expired | abandoned)


def without_files(jobs: DataFrame) -> DataFrame:
    """The job rows as they read once their files are gone."""
    nothing = F.lit(None).cast("string")
    return (
        jobs.withColumn("blob_path", nothing)
        .withColumn("excel_blob_path", nothing)
        .withColumn("file_size", F.lit(0).cast("bigint"))
    )


def slow_requests(requests: DataFrame, threshold_ms: int = codes.SLOW_REQUEST_MS) -> DataFrame:
    """O-67: requests at or above the threshold, bodies cut to the logged length.

    Stateless, so it serves batch and streaming frames alike.
    """
    return requests.where(F.col("elapsed_ms") >= threshold_ms).select(
        "request_id",
        "endpoint",
        F.col("elapsed_ms").alias("query_time_ms"),
        F.lit(threshold_ms).cast("bigint").alias("threshold_ms"),
        F.substring("request_body", 1, codes.LOGGED_BODY_CHARS).alias("request_body"),
        "occurred_at",
    )
