"""Helpers shared by the operators: stored intermediate tables, words and their hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words a worker remembers the hashes of within a task, at most; further words are hashed each time. Words that come up
#: often come up early, so more of them are memory without much use.
REMEMBERED_WORDS = 100_000
#: Rows of a batch that are worked on at a time.
SLICE_ROWS = 256
#: While an intermediate table is written: its shuffle files go as soon as it is, where they would stay until the driver
#: collects its garbage, and Arrow batches hold less than the 64 MB of Spark's default outside the heap.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: that of ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: the lineage ends there and lost executors lose nothing."""
    spark = frame.sparkSession
    path = new_folder(spark, name)
    before = {key: spark.conf.get(key) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            spark.conf.set(key, value)
        frame.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote, through Spark's file systems, once no result needs it any more."""
    for frame in frames:
        target = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        target.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED_WORDS:
            self[word] = value
        return value


_CACHES: list[dict] = []


def task_cache(cache: dict) -> dict:
    """Registers what a Python worker remembers within a task; Spark uses workers again, so ``forget`` empties it after each."""
    _CACHES.append(cache)
    return cache


def forget() -> None:
    """Empties the caches of this worker and gives back the memory that Arrow keeps for later batches."""
    for cache in _CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()


_HASHES = task_cache(WordHashes())


def hashed(words: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit hash per word."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values over all positions."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words, in text order; none when there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= _PRIME
        out += hashes[k : k + count]
    return mixed(out)


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], n: int = 5) -> np.ndarray:
    """Hashes of the n-word shingles in text order; a shorter text is one shingle, a text without words none."""
    if not words:
        return np.empty(0, np.uint64)
    return runs_of(hashed(words), min(n, len(words)))


def kept_apart(frame: DataFrame, names: str) -> tuple[DataFrame, list]:
    """The frame with columns of these (space-separated) names renamed, and the columns to select to get it back."""
    clashing = {c: f"own_{i}_{c}" for i, c in enumerate(frame.columns) if c.lower() in names.split()}
    return frame.withColumnsRenamed(clashing), [F.col(f"`{clashing.get(c, c)}`").alias(c) for c in frame.columns]


def appended(frame: DataFrame, needed: list[str], rows: Callable[[dict[str, list]], dict[str, list]], ddl: str) -> DataFrame:
    """The frame with columns that ``rows`` makes from the needed ones, a few rows at a time, inside Arrow batches.

    All other columns pass through untouched, so repeated rows and null ids keep what belongs to them. ``ddl`` names
    the new columns; old ones of the same name (case aside) are replaced.
    """
    new = StructType.fromDDL(ddl)
    taken = {f.name.lower() for f in new}
    frame = frame.select(*[f"`{n}`" for n in frame.columns if n.lower() not in taken])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(start, SLICE_ROWS)
                    made = rows({n: part.column(n).to_pylist() for n in needed})
                    arrays = [pa.array(made[f.name], f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *arrow.names])
        finally:
            forget()

    return frame.mapInArrow(run, StructType([*frame.schema.fields, *new.fields]))


def exploded(frame: DataFrame, rows: Callable[[dict[str, list]], dict[str, object]], ddl: str) -> DataFrame:
    """Rows of their own made from a frame: ``rows`` gets a few rows as columns and gives columns of any length."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE_ROWS):
                    made = rows(batch.slice(start, SLICE_ROWS).to_pydict())
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            forget()

    return frame.mapInArrow(run, schema)
