"""Contains-search through an inverted index of trigrams (O-33, O-34, O-36, O-64f, O-64j).

Every text is cut into the three-character pieces of its lower-case form; two end marks follow it, so that the
last characters start pieces too and a term of one or two characters is the beginning of some piece. Postings
lie in chunks of 32 768 ids: a piece that a third of all rows hold becomes many rows of bounded size. Inside a
chunk ids are ascending offsets, which the file format stores as deltas. A search looks its pieces up in a small
directory, takes the rarest, intersects their chunks beginning with the shortest list, and verifies what is
left on the stored texts, of which only the id blocks with candidates are read.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlines.functions.scalars import contains_text, quoted

# Ids of a chunk of postings and of a block of texts, as powers of two.
CHUNK_BITS, BLOCK_BITS = 15, 24
# Pieces of a term that are looked up, and rarest ones whose postings are read. Any choice gives all rows: hits are verified.
LOOKED_UP, INTERSECTED = 64, 4

_END = r"'\0'"
# (table, column) -> key of the rows.
FIELDS = {
    ("observation", "collection_code"): "observation_id",
    ("observation", "catalog_number"): "observation_id",
    ("organization", "name"): "organization_id",
    ("taxon", "preferred_popular_name"): "taxon_id",
    ("taxon_name", "scientific_name"): "taxon_name_id",
    ("taxon_name", "scientific_name_authorship"): "taxon_name_id",
    ("taxon_popular_name", "name"): "taxon_popular_name_id",
}


_SCHEMAS = {
    "postings": "piece string, chunk bigint, size int, offsets array<smallint>, field string",
    "pieces": "piece string, size bigint, field string",
    "texts": "id bigint, text string, field string, block bigint",
}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(posixpath.join(path, name))


def field_of(table: str, column: str) -> str:
    return f"{table}.{column}"


def pieces_of(term: str) -> list[str]:
    """Distinct three-character pieces of a lower-case term, in order."""
    return list(dict.fromkeys(term[i : i + 3] for i in range(len(term) - 2)))


def _pieces(text: str) -> str:
    """The pieces of a text column as an SQL expression, linear in its length; none for an empty text."""
    piece = f"concat(c[i], coalesce(get(c, i + 1), {_END}), coalesce(get(c, i + 2), {_END}))"
    # a one-element array gives the characters a name
    cut = f"transform(array(split(lower({text}), '')), c -> transform(sequence(0, size(c) - 1), i -> {piece}))[0]"
    return f"array_distinct(IF({text} = '', CAST(array() AS array<string>), {cut}))"


def text_rows(tables: object, fields: tuple[tuple[str, str], ...] = tuple(FIELDS)) -> DataFrame:
    """(field, id, text) of the searchable columns; rows without a text or a key are left out, as they match nothing."""
    out = None
    for table, column in fields:
        key = FIELDS[table, column]
        rows = getattr(tables, table).where(f"{column} IS NOT NULL AND {key} IS NOT NULL").selectExpr(
            f"'{field_of(table, column)}' AS field", f"CAST({key} AS BIGINT) AS id", f"{column} AS text"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def postings(rows: DataFrame) -> DataFrame:
    """(field, piece, chunk, size, offsets): ids that hold a piece, by chunk, ascending and distinct.

    Texts are dealt out before they are cut: a small file of names is a task or two, and its pieces are many.
    """
    cut = rows.repartition("id").select("field", F.explode(F.expr(_pieces("text"))).alias("piece"), "id")
    offset = f"CAST(id & {(1 << CHUNK_BITS) - 1} AS SMALLINT)"
    chunked = cut.selectExpr("field", "piece", f"shiftright(id, {CHUNK_BITS}) AS chunk", f"{offset} AS offset")
    gathered = chunked.groupBy("field", "piece", "chunk").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))
    return gathered.selectExpr("field", "piece", "chunk", "size(offsets) AS size", "offsets")


def write_text_index(rows: DataFrame, path: str, mode: str = "error", files: int | None = None) -> None:
    """Store the index of (field, id, text) rows below ``path``.

    ``mode="append"`` adds rows with new ids to an index: their chunks stand beside the stored ones, and searches
    take both. A row whose text changes needs its field written anew.
    """
    spark = rows.sparkSession
    count = [files] if files else []
    (
        postings(rows)
        .repartitionByRange(*count, "field", "piece", "chunk")
        .sortWithinPartitions("field", "piece", "chunk")
        .write.mode(mode)
        .partitionBy("field")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary#offsets.list.element", "false")
        .parquet(posixpath.join(path, "postings"))
    )
    # The directory sums all postings, so an appended index gets a new one.
    (
        _read(spark, path, "postings").groupBy("field", "piece").agg(F.sum("size").alias("size"))
        .repartitionByRange(*count, "field", "piece").sortWithinPartitions("field", "piece")
        .write.mode("overwrite").partitionBy("field").parquet(posixpath.join(path, "pieces"))
    )
    blocked = rows.withColumn("block", F.expr(f"shiftright(id, {BLOCK_BITS})"))
    (
        blocked.repartitionByRange(*count, "field", "id").sortWithinPartitions("field", "block", "id")
        .write.mode(mode).partitionBy("field", "block").parquet(posixpath.join(path, "texts"))
    )


@dataclass(frozen=True)
class TextIndex:
    """A stored index; each search reads the partitions of one field."""

    spark: SparkSession
    path: str

    def _part(self, name: str, field: str) -> DataFrame:
        return _read(self.spark, self.path, name).where(F.col("field") == field)

    def rarest(self, field: str, term: str) -> list[str] | None:
        """The pieces of a term to intersect, rarest first; None when some piece is in no text. One small job."""
        wanted = pieces_of(term.lower())[:LOOKED_UP]
        found = self._part("pieces", field).where(F.col("piece").isin(wanted)).select("piece", "size").collect()
        if len(found) < len(wanted):
            return None
        return [piece for piece, _ in sorted(map(tuple, found), key=lambda row: (row[1], row[0]))][:INTERSECTED]

    def candidates(self, field: str, term: str) -> DataFrame:
        """Ids whose texts hold the term's rarest pieces, or for a term of one or two characters a piece beginning so."""
        term = term.lower()
        lists = self._part("postings", field)
        if len(term) < 3:
            kept = lists.where(F.col("piece").startswith(term)).select("chunk", F.explode("offsets").alias("offset"))
            kept = kept.distinct()
        else:
            pieces = self.rarest(field, term)
            if pieces is None:
                return self._part("texts", field).select("id").limit(0)
            lists = lists.where(F.col("piece").isin(pieces))
            chunks = lists.groupBy("chunk").agg(F.collect_list(F.struct("piece", "offsets")).alias("lists"))
            own = [f"flatten(transform(filter(lists, x -> x.piece = {quoted(p)}), x -> x.offsets))" for p in pieces]
            common = own[0]
            for following in own[1:]:
                common = f"array_intersect({common}, {following})"
            # an appended chunk may name an id again
            kept = chunks.select("chunk", F.explode(F.expr(f"array_distinct({common})")).alias("offset"))
        return kept.selectExpr(f"shiftleft(chunk, {CHUNK_BITS}) | CAST(offset AS BIGINT) AS id")

    def ids(self, table: str, column: str, term: str) -> DataFrame:
        """Keys of the rows whose column contains a term, as ``contains_text`` decides; an empty term finds every text."""
        field = field_of(table, column)
        texts = self._part("texts", field)
        if term:
            block = F.expr(f"shiftright(id, {BLOCK_BITS})")
            found = self.candidates(field, term).withColumn("block", block)
            texts = texts.join(found, ["block", "id"], "left_semi").where(contains_text("text", term))
        return texts.select(F.col("id").alias(FIELDS[table, column])).distinct()


def with_text(df: DataFrame, tables: object, table: str, column: str, term: str) -> DataFrame:
    """Rows of a table whose column contains a term: through the stored text index, else by a scan."""
    if tables.text_index is None:
        return df.where(contains_text(column, term))
    return df.join(tables.text_index.ids(table, column, term), FIELDS[table, column], "left_semi")
