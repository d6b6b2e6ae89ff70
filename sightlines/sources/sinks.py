"""Result sinks: CSV exports and JSON lines (O-04, O-05)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.operators.export import as_text, csv_line, exceeds_limit
from sightlines.operators.locations import LOCATION_LINE
from sightlines.sources.shared import stored

BYTE_ORDER_MARK = "\ufeff"
SEPARATOR_HINT = "sep=;"
#: Bytes of a document that one task copies.
BLOCK_BYTES = 64 << 20


def write_csv(rows: DataFrame, path: str, order_by: str = "Id", mode: str = "error") -> None:
    """O-04, O-64d: a distributed CSV in id order, one header per part file (T-18).

    Finding the ranges runs the plan of ``rows`` once more for a sample of the keys.
    """
    key = F.col(f"`{order_by}`")
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    (
        as_text(ordered)
        .write.mode(mode)
        .option("header", True)
        .option("sep", ";")
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("encoding", "UTF-8")
        .csv(path)
    )


def write_csv_document(
    rows: DataFrame, path: str, order_by: str = "Id", limit: int = codes.EXPORT_HARD_LIMIT, mode: str = "error"
) -> None:
    """O-04 as one file with byte-order mark, separator hint and header.

    For exports within the row limit only; a larger one is refused, not cut.
    """
    if exceeds_limit(rows, limit):
        raise ValueError(f"more than {limit} rows; use write_csv")
    text = as_text(rows)
    # The header passes through the same field quoting as the data.
    names = rows.sparkSession.range(1).select(*[F.lit(c).alias(c) for c in text.columns])
    header = names.select(csv_line(text.columns)).first()[0]
    lines = text.select(F.col(f"`{order_by}`").cast("bigint").alias("key"), csv_line(text.columns).alias("value"))
    write_document(lines, path, ["key"], head=f"{BYTE_ORDER_MARK}{SEPARATOR_HINT}\n{header}\n", mode=mode)


def write_location_document(located: DataFrame, path: str, epsg: int, mode: str = "error") -> None:
    """O-05 as one JSON file of any size: the most observed location first, a line for each."""
    lines = stored(located.selectExpr("-observation_count AS rank", "location_id", f"{LOCATION_LINE} AS line"), "lines")
    first = lines.agg(F.min(F.struct("rank", "location_id")).alias("key")).first().key
    comma = F.lit("") if first is None else F.when(F.col("location_id") == first.location_id, "").otherwise(",")
    lines = lines.select("rank", "location_id", F.concat(comma, "line").alias("value"))
    write_document(lines, path, ["rank", "location_id"], f'{{"epsg":{int(epsg)},"locations":[\n', "]}\n", mode)


def write_document(
    lines: DataFrame, path: str, order_by: list[str], head: str = "", foot: str = "", mode: str = "error"
) -> None:
    """The column ``value`` as lines of one file ``part-00000.txt`` below ``path``, in order, between head and foot.

    Ranges of lines are written in parallel; their lengths give each one's place in the document. On a shared POSIX
    file system tasks copy blocks of at most ``BLOCK_BYTES`` to their places, so a repeated task writes the same bytes again; on
    others the file system joins the parts itself. The document appears under its name when it is whole. ``mode`` is
    ``error`` or ``overwrite``. A null value is an empty line.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode {mode}")
    spark = lines.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    folder = make(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(folder) and mode == "error":
        raise FileExistsError(path)
    parts = make(folder.getParent(), f"_{folder.getName()}-{uuid.uuid4().hex}")
    ordered = lines.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered.select(F.coalesce("value", F.lit("")).alias("value")).write.text(parts.toString())
    found = [s for s in files.listStatus(parts) if s.getPath().getName().startswith("part-")]
    found.sort(key=lambda s: (int(s.getPath().getName().split("-")[1]), s.getPath().getName()))
    whole = make(parts, "whole")
    if files.getUri().getScheme() == "file":
        local = [(s.getPath().toUri().getPath(), s.getLen()) for s in found]
        _copied(spark, whole.toUri().getPath(), local, head.encode(), foot.encode())
    else:
        _concatenated(spark, files, whole, [s.getPath() for s in found], make(parts, "foot"), head.encode(), foot.encode())
    files.delete(folder, True)
    files.mkdirs(folder)
    if not files.rename(whole, make(folder, "part-00000.txt")):
        raise OSError(f"can't rename to {path}")
    files.delete(parts, True)


def _copied(spark: SparkSession, target: str, parts: list[tuple[str, int]], head: bytes, foot: bytes) -> None:
    """The document by tasks that write blocks of the parts at their places."""
    blocks, at = [], len(head)
    for source, length in parts:
        blocks += [(source, start, min(BLOCK_BYTES, length - start), at + start) for start in range(0, length, BLOCK_BYTES)]
        at += length
    with open(target, "xb") as file:
        file.write(head)
        file.seek(at)
        file.write(foot)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                # never created here: a task that outlives the job must not bring the file back
                with open(row["source"], "rb") as source, open(row["target"], "r+b") as file:
                    source.seek(row["start"])
                    file.seek(row["at"])
                    left = row["length"]
                    while left and (data := source.read(min(left, 1 << 20))):
                        file.write(data)
                        left -= len(data)
            yield pa.RecordBatch.from_pydict({"done": pa.array([batch.num_rows], pa.int64())})

    if blocks:
        rows = spark.createDataFrame([(target, *b) for b in blocks], "target string, source string, start long, length long, at long")
        done = rows.repartition(len(blocks), "at").mapInArrow(copy, "done long").agg(F.sum("done")).first()[0]
        if done != len(blocks):
            raise OSError(f"{done} of {len(blocks)} blocks written")


def _concatenated(spark: SparkSession, files, whole, parts: list, end, head: bytes, foot: bytes) -> None:
    """The document by the file system's own concatenation, which moves no data; others refuse."""
    for path, data in ((whole, head), (end, foot)):
        stream = files.create(path)
        stream.write(bytearray(data))
        stream.close()
    joined = [*[p for p in parts if files.getFileStatus(p).getLen()], *([end] if foot else [])]
    if joined:
        array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(joined))
        for i, p in enumerate(joined):
            array[i] = p
        files.concat(whole, array)


def write_lines(lines: DataFrame, path: str, column: str = "line", mode: str = "error") -> None:
    """One text line per row: compact locations or GeoJSON features."""
    lines.select(column).write.mode(mode).text(path)
