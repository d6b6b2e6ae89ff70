"""Stored counts per area for any index filter: a data cube with partial cuboids (O-55, O-59).

The base cuboid counts observations by entity and all dimensions. Coarser cuboids come from it in one pass, never from the
observations again. A request names the dimensions it filters; it is answered from the smallest stored cuboid that has
them, by adding up cells. Cells are additive: those of new observations are added, those of removed ones taken off, and
nothing is counted anew.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.operators.filters import ObservationFilter
from sightlines.sources.shared import shuffle_partitions
from sightlines.sources.tables import OccurrenceTables

ENTITY = ("entity_type_id", "entity_id")
# Years count double, and one more in their last second, which a period's end leaves out (see by year in ``bitmaps``).
_YEAR = (
    "2 * year(date_time_collected) + CAST(date_time_collected > make_timestamp_ntz(year(date_time_collected), 12, 31, 23,"
    " 59, 59) AS INT)"
)
DIMENSIONS = {
    "taxon_group_id": "taxon_group_id",
    "category_id": "category_id",
    "basis_of_record_id": "basis_of_record_id",
    "registration_status_id": "registration_status_id",
    "has_media_files": "has_media_files",
    "year_month": f"100 * ({_YEAR}) + month(date_time_collected)",
}
_ALL = tuple(DIMENSIONS)
# Dimensions of the stored cuboids; the first is the base. Others may be chosen when a cube is written.
CUBOIDS = (
    _ALL, ("taxon_group_id",), ("category_id",), ("basis_of_record_id",), ("registration_status_id", "has_media_files"),
    ("year_month",), ("taxon_group_id", "category_id"), ("taxon_group_id", "basis_of_record_id"),
    ("taxon_group_id", "year_month"), ("taxon_group_id", "category_id", "registration_status_id", "has_media_files"),
)
SCHEMA = (
    "entity_type_id int, entity_id int, taxon_group_id int, category_id int, basis_of_record_id int,"
    " registration_status_id int, has_media_files boolean, year_month int, n bigint, cuboid int"
)


def base_cells(index: DataFrame) -> DataFrame:
    """Counts of enriched index rows by entity and all dimensions; null is a value of its own."""
    named = index.selectExpr(*ENTITY, *[f"{e} AS {n}" for n, e in DIMENSIONS.items()])
    return named.groupBy(*ENTITY, *_ALL).agg(F.count("*").alias("n"))


def merged_cells(cells: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Base cells after observations came and went; cells of no observation go."""
    every = cells
    if added is not None:
        every = every.unionByName(added)
    if removed is not None:
        every = every.unionByName(removed.withColumn("n", -F.col("n")))
    return every.groupBy(*ENTITY, *_ALL).agg(F.sum("n").alias("n")).where("n <> 0")


def cuboid_cells(base: DataFrame, cuboids: tuple[tuple[str, ...], ...] = CUBOIDS, files: int | None = None) -> DataFrame:
    """Cells of all cuboids from base cells, with the number of the cuboid; dimensions it lacks are null.

    Every cuboid has the entity, so base cells are dealt by ranges of entities and added up where they are: no cell moves
    once for each cuboid. An entity has no more base cells than its dimensions have combinations, however many observations
    it has. ``files`` is the number of ranges, by default that of shuffle partitions.
    """
    kinds = {name: base.schema[name].dataType.simpleString() for name in _ALL}
    dealt = base.repartitionByRange(files or shuffle_partitions(base.sparkSession), *ENTITY)
    rows = ", ".join(
        "struct(" + ", ".join(f"{name if name in cuboid else f'CAST(NULL AS {kind})'} AS {name}" for name, kind in kinds.items())
        + f", {number} AS cuboid)"
        for number, cuboid in enumerate(cuboids)
    )
    each = dealt.selectExpr(*ENTITY, "n", f"inline(array({rows}))")
    cells = each.groupBy("cuboid", *ENTITY, *_ALL).agg(F.sum("n").alias("n"))
    return cells.select(*ENTITY, *_ALL, "n", "cuboid")


def write_cube(
    base: DataFrame, path: str, cuboids: tuple[tuple[str, ...], ...] = CUBOIDS, mode: str = "error", files: int | None = None
) -> None:
    """Store the cuboids of base cells below ``path``, partitioned by cuboid, sorted by entity, with their sizes."""
    if set(cuboids[0]) != set(_ALL):
        raise ValueError("the first cuboid is the base and has all dimensions")
    ordering = ("cuboid", *ENTITY)
    cells = posixpath.join(path, "cells")
    (
        cuboid_cells(base, cuboids, files)
        .sortWithinPartitions(*ordering)
        .write.mode(mode).partitionBy("cuboid").parquet(cells)
    )
    spark = base.sparkSession
    named = spark.createDataFrame([(i, list(c)) for i, c in enumerate(cuboids)], "cuboid int, dimensions array<string>")
    sizes = spark.read.schema(SCHEMA).parquet(cells).groupBy("cuboid").agg(F.count("*").alias("cells"))
    named.join(sizes, "cuboid", "left").na.fill(0, ["cells"]).write.mode(mode).parquet(posixpath.join(path, "cuboids"))


def conditions_of(f: ObservationFilter) -> dict[str, list[str]] | None:
    """Conditions on cells by the dimension they need; None for a request that cells can't answer.

    Status and media are judged as the entity index has them (T-04).
    """
    if f.has_geography or f.needs_observation_rows or f.precision_from is not None or f.precision_to is not None:
        return None
    if f.preferred_popular_name or f.scientific_name or f.author or f.envelope is not None:
        return None
    found: dict[str, list[str]] = {}
    for name, wanted in (
        ("taxon_group_id", f.taxon_group_ids), ("category_id", f.category_ids), ("basis_of_record_id", f.basis_of_record_ids),
        ("registration_status_id", () if f.registration_status_id is None else (f.registration_status_id,)),
        ("year_month % 100", f.months),
    ):
        if wanted:
            found.setdefault(name.split()[0], []).append(f"{name} IN ({', '.join(str(int(v)) for v in wanted)})")
    if f.period_from is not None:
        found.setdefault("year_month", []).append(f"year_month >= {200 * f.period_from}")
    if f.period_to is not None:
        found.setdefault("year_month", []).append(f"year_month < {100 * (2 * f.period_to + 1)}")
    if f.with_images is not None:
        found["has_media_files"] = ["has_media_files" if f.with_images else "NOT has_media_files"]
    return found


@dataclass(frozen=True)
class Cube:
    """A stored cube."""

    spark: SparkSession
    path: str

    def answers(self, f: ObservationFilter) -> bool:
        return conditions_of(f) is not None

    def cuboids(self) -> list[tuple[int, tuple[str, ...], int]]:
        """(number, dimensions, cells) of what is stored, smallest first: a row for each cuboid."""
        rows = self.spark.read.schema("cuboid int, dimensions array<string>, cells bigint").parquet(
            posixpath.join(self.path, "cuboids")
        )
        return sorted(((r.cuboid, tuple(r.dimensions), r.cells) for r in rows.collect()), key=lambda c: (c[2], c[0]))

    def chosen(self, f: ObservationFilter) -> int:
        """The number of the smallest cuboid that has the dimensions of a request."""
        needed = set(conditions_of(f))
        return next(number for number, dimensions, _ in self.cuboids() if needed <= set(dimensions))

    def cells(self, cuboid: int) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(posixpath.join(self.path, "cells")).where(f"cuboid = {int(cuboid)}")

    def base(self) -> DataFrame:
        """The base cells, to be merged and written anew."""
        return self.cells(0).drop("cuboid")

    def entity_counts(self, f: ObservationFilter, keys: DataFrame) -> DataFrame:
        """O-55: observations of each wanted entity under a request that cells answer."""
        conditions = [c for found in conditions_of(f).values() for c in found]
        cells = self.cells(self.chosen(f)).where(" AND ".join([f"entity_type_id < {codes.INSTITUTION}", *conditions]))
        cells = cells.join(keys, list(ENTITY), "left_semi")
        return cells.groupBy(*ENTITY).agg(F.sum("n").alias("observation_count"))


def changed_base(cube: Cube, before: OccurrenceTables, after: OccurrenceTables) -> DataFrame:
    """Base cells of a cube once the rows of ``before`` were replaced by those of ``after``.

    Both hold changed observations alone, as they were and as they are: an added one is in ``after``, a removed one in
    ``before``, a moved one in both.
    """
    return merged_cells(cube.base(), base_cells(after.enriched_index), base_cells(before.enriched_index))
