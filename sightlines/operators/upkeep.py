"""Resumable backfill and upkeep of the stored entity index (O-43, O-06).

The index is stored in batches, partitions of consecutive observation ids. A backfill writes some batches at a time and
enters them in a journal once they are committed; a run that was killed goes on behind the journal, and what it had written
of other batches is overwritten. Changed observations touch the batches of their ids alone: those are read, freed of the
changed rows, given the new ones and replaced, all other partitions stay as they are.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlines import schema
from sightlines.operators.index import FILTER_COLUMNS, INDEX_KEYS, backfill, index_enriched
from sightlines.sources.shared import stored
from sightlines.sources.tables import OccurrenceTables

# Observation ids of a batch, and batches of one job.
BATCH_IDS, TOGETHER = 50_000_000, 20

# Ids of a block, whose rows one task writes, as a power of two.
_BLOCK_BITS = 15
_COLUMNS = (*INDEX_KEYS, *FILTER_COLUMNS)
# Tables with rows per observation, which an id range cuts alike.
_BY_OBSERVATION = ("observation", "observation_tag", "observation_behavior", "media_file", "organization_relation")


def _batch(batch_ids: int) -> str:
    return f"floor(observation_id / {int(batch_ids)})"


def within_ids(tables: OccurrenceTables, low: int, high: int) -> OccurrenceTables:
    """The tables with the rows of observations ``low`` .. ``high``; the range reaches their scans."""
    for name in _BY_OBSERVATION:
        rows = getattr(tables, name).where(F.col("observation_id").between(low, high))
        tables = tables.with_table(name, rows)
    return tables


def of_observations(tables: OccurrenceTables, ids: DataFrame) -> OccurrenceTables:
    """The tables with the rows of some observations."""
    for name in _BY_OBSERVATION:
        tables = tables.with_table(name, getattr(tables, name).join(ids, "observation_id", "left_semi"))
    return tables


def _write(rows: DataFrame, path: str, batches: DataFrame | None = None) -> None:
    """Replaces the partitions of the rows and of ``batches``, where a row without keys marks each, so that an emptied one is
    replaced too. Rows meet by block of ids: no ranges are sampled, which would derive the rows twice, and a large batch is
    many blocks."""
    every = rows.select(*_COLUMNS, "batch")
    if batches is not None:
        every = every.unionByName(batches.select(*[F.lit(None).alias(c) for c in _COLUMNS], "batch"))
    (
        every.repartition("batch", F.expr(f"shiftright(observation_id, {_BLOCK_BITS})"))
        .sortWithinPartitions("batch", "entity_type_id", "entity_id", "observation_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
        .parquet(posixpath.join(path, "rows"))
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schema.OCCURRENCE["entity_index"] + ", batch bigint").parquet(posixpath.join(path, "rows"))
    return rows.where("observation_id IS NOT NULL")


def batched_index(spark: SparkSession, path: str) -> DataFrame:
    """The index stored in batches."""
    return _stored(spark, path).select(*_COLUMNS)


def finished_batches(spark: SparkSession, path: str) -> set[int]:
    """What the journal holds; empty before the first batch. One row for each batch."""
    folder = posixpath.join(path, "journal")
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return set()
    return {r.batch for r in spark.read.schema("batch bigint").parquet(folder).collect()}


def backfill_batches(
    index: DataFrame, tables: OccurrenceTables, path: str, batch_ids: int = BATCH_IDS, together: int = TOGETHER,
    jobs: int | None = None,
) -> int:
    """O-43 in batches: fills the marked rows of an index and stores all its rows; gives the batches this run finished.

    Safe to stop anywhere and to call again: finished batches are passed over, half-written ones replaced. ``jobs`` ends
    a run after so many jobs. Each job reads the id range of its batches.
    """
    spark = index.sparkSession
    every = index.select(F.expr(_batch(batch_ids)).alias("batch")).distinct().collect()
    todo = sorted({r.batch for r in every} - finished_batches(spark, path))
    done = 0
    for start in range(0, len(todo), together)[:jobs]:
        batches = todo[start : start + together]
        low, high = batches[0] * batch_ids, (batches[-1] + 1) * batch_ids - 1
        chosen = F.expr(_batch(batch_ids)).isin(batches)
        part = index.where(F.col("observation_id").between(low, high)).where(chosen)
        filled = backfill(part, within_ids(tables, low, high)).withColumn("batch", F.expr(_batch(batch_ids)))
        finished = spark.createDataFrame([(b,) for b in batches], "batch bigint")
        _write(filled, path, finished)
        finished.coalesce(1).write.mode("append").parquet(posixpath.join(path, "journal"))
        done += len(batches)
    return done


def write_batched_index(index: DataFrame, path: str, batch_ids: int = BATCH_IDS) -> None:
    """Store a whole index in batches. Each has rows, so that none is looked for beside them: the index is derived once."""
    _write(index.withColumn("batch", F.expr(_batch(batch_ids))), path)


def merge_changes(changed: DataFrame, tables: OccurrenceTables, path: str, batch_ids: int = BATCH_IDS) -> None:
    """Brings the stored index up to date for changed observations (observation_id), from the tables as they are now.

    Added, moved, retagged and removed observations alike: their old rows go, and new ones come for those that exist.
    Only the batches of changed ids are rewritten. ``changed`` may repeat ids; it is read once and its ids are stored, as six
    joins need them. The new rows of the batches are complete in the shared folder before the first partition is replaced.
    """
    spark = changed.sparkSession
    ids = stored(changed.select("observation_id").where("observation_id IS NOT NULL").distinct(), "changed_ids")
    touched = stored(ids.select(F.expr(_batch(batch_ids)).alias("batch")).distinct(), "touched")
    kept = _stored(spark, path).join(touched, "batch", "left_semi").join(ids, "observation_id", "left_anti")
    fresh = index_enriched(of_observations(tables, ids)).withColumn("batch", F.expr(_batch(batch_ids)))
    merged = kept.select(*_COLUMNS, "batch").unionByName(fresh.select(*_COLUMNS, "batch"))
    _write(stored(merged, "changed_batches"), path, touched)
