"""The observation-to-entity index (O-40 .. O-45).

``(observation_id, entity_type_id, entity_id)`` for every current area an
observation lies in and every institution it belongs to, with seven
observation columns copied next to the keys.

Observation ids are unique, so the DISTINCT of the area rows is taken on the
location side of the join, where there are far fewer rows. What is left is one
equi-join on ``location_id``; a location that holds a large share of all
observations is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.functions.scalars import area_entity_id, default_zoom_level, quoted, registration_status
from sightlines.sources.tables import OccurrenceTables

INDEX_KEYS = ("observation_id", "entity_type_id", "entity_id")
FILTER_COLUMNS = (
    "taxon_group_id", "category_id", "basis_of_record_id", "coordinate_precision_m",
    "date_time_collected", "registration_status_id", "has_media_files",
)


def _current_entities(tables: OccurrenceTables) -> DataFrame:
    return tables.area.where("is_current").selectExpr(
        "area_id", "area_type_id AS entity_type_id", f"{area_entity_id('fid', 'area_type_id')} AS entity_id"
    )


def location_area_entities(tables: OccurrenceTables) -> DataFrame:
    """(location, entity) pairs of existing locations and current areas; may repeat."""
    return (
        tables.location_area.join(_current_entities(tables).where("entity_id IS NOT NULL"), "area_id")
        .join(tables.location.select("location_id"), "location_id", "left_semi")
        .select("location_id", "entity_type_id", "entity_id")
    )


def index_rejects(tables: OccurrenceTables) -> DataFrame:
    """Current areas whose fid is no number and which the index therefore leaves out (T-16)."""
    rejected = _current_entities(tables).where("entity_id IS NULL").select("area_id")
    return tables.area.join(rejected, "area_id", "left_semi").select("area_id", "area_type_id", "fid")


def index_areas(tables: OccurrenceTables) -> DataFrame:
    """O-40: area rows."""
    entities = location_area_entities(tables).distinct()
    located = tables.observation.select("observation_id", "location_id")
    return located.join(entities, "location_id").select(*INDEX_KEYS)


def index_institutions(tables: OccurrenceTables) -> DataFrame:
    """O-41: institution rows. Relations are made distinct by their own columns, as they may be dealt by these."""
    institutions = tables.organization.where(
        f"organization_type_id = {codes.INSTITUTION_ORGANIZATION_TYPE}"
    ).select("organization_id")
    return (
        tables.organization_relation.join(institutions, "organization_id", "left_semi")
        .select("observation_id", "organization_id")
        .distinct()
        .selectExpr(
            "observation_id",
            f"{codes.INSTITUTION} AS entity_type_id",
            "CAST(organization_id AS INT) AS entity_id",
        )
    )


def index_all(tables: OccurrenceTables) -> DataFrame:
    """O-42: both kinds of rows; their entity types never overlap."""
    return index_areas(tables).unionByName(index_institutions(tables))


def observation_status(tables: OccurrenceTables) -> DataFrame:
    """O-14 for observations that carry a deciding tag: (observation_id, registration_status_id)."""
    not_recovered = f"max(tag_id = {codes.TAG_NOT_RECOVERED})"
    absent = f"max(tag_id = {codes.TAG_ABSENT})"
    return (
        tables.observation_tag.where(f"tag_id IN ({codes.TAG_ABSENT}, {codes.TAG_NOT_RECOVERED})")
        .groupBy("observation_id")
        .agg(F.expr(registration_status(not_recovered, absent)).alias("registration_status_id"))
    )


def observation_attributes(tables: OccurrenceTables, partitions: int | None = None) -> DataFrame:
    """The filter columns per observation (O-14, O-15), with its location.

    ``partitions`` is a number that all sides of the join are dealt into; without it they are left to adaptive execution.
    """
    media = (
        tables.media_file.select("observation_id")
        .where("observation_id IS NOT NULL")
        .distinct()
        .selectExpr("observation_id", "TRUE AS has_media_files")
    )
    sides = [tables.observation.select("observation_id", "location_id", *FILTER_COLUMNS[:5]), observation_status(tables), media]
    if partitions is not None:
        sides = [side.repartition(partitions, "observation_id") for side in sides]
    own, status, media = sides
    return (
        own.join(status, "observation_id", "left")
        .join(media, "observation_id", "left")
        .selectExpr(
            "observation_id",
            "location_id",
            *FILTER_COLUMNS[:5],
            f"coalesce(registration_status_id, {codes.STATUS_FOUND}) AS registration_status_id",
            "coalesce(has_media_files, FALSE) AS has_media_files",
        )
    )


def as_unfilled(keys: DataFrame) -> DataFrame:
    """Index keys as rows that still wait for their filter columns."""
    return keys.selectExpr(
        *INDEX_KEYS,
        f"{codes.UNFILLED_TAXON_GROUP} AS taxon_group_id",
        "CAST(NULL AS INT) AS category_id",
        "0 AS basis_of_record_id",
        "CAST(NULL AS INT) AS coordinate_precision_m",
        "CAST(NULL AS TIMESTAMP_NTZ) AS date_time_collected",
        "0 AS registration_status_id",
        "FALSE AS has_media_files",
    )


def _fill(todo: DataFrame, tables: OccurrenceTables) -> DataFrame:
    """Filter columns from the observation; a row without an observation keeps its own."""
    attributes = observation_attributes(tables).selectExpr("observation_id", *FILTER_COLUMNS, "TRUE AS found")
    filled = [f"IF(a.found, a.{name}, i.{name}) AS {name}" for name in FILTER_COLUMNS]
    return todo.alias("i").join(attributes.alias("a"), "observation_id", "left").selectExpr(*INDEX_KEYS, *filled)


def backfill(index: DataFrame, tables: OccurrenceTables) -> DataFrame:
    """O-43: fill the marked rows, pass finished ones through; safe to repeat.

    A marked row without an observation stays marked.
    """
    marked = f"taxon_group_id = {codes.UNFILLED_TAXON_GROUP}"
    done = index.where(f"NOT ({marked})").select(*INDEX_KEYS, *FILTER_COLUMNS)
    return _fill(index.where(marked), tables).unionByName(done)


def index_enriched(tables: OccurrenceTables) -> DataFrame:
    """O-43 from scratch: the whole index with its filter columns.

    Area rows take the columns from the observation side of the location join, so
    only institution rows need a join on the observation id.
    """
    entities = location_area_entities(tables).distinct()
    areas = (
        observation_attributes(tables)
        .join(entities, "location_id")
        .select(*INDEX_KEYS, *FILTER_COLUMNS)
    )
    return areas.unionByName(_fill(as_unfilled(index_institutions(tables)), tables))


def write_entity_index(index: DataFrame, path: str, mode: str = "error", files: int | None = None) -> None:
    """O-06: store the index partitioned by entity type.

    Range partitioning on (type, entity, observation) gives files of equal size
    even when one entity holds most rows, and narrow min/max statistics on
    ``entity_id``, so that an area filter skips most files. Sampling the ranges
    repeats the last stage of the build; its shuffles are reused. ``files`` is the number of ranges; without it the
    session's number of shuffle partitions holds, which suits small tables only.
    """
    ordering = ("entity_type_id", "entity_id", "observation_id")
    (
        index.repartitionByRange(*([files] if files else []), *ordering)
        .sortWithinPartitions(*ordering)
        .write.mode(mode)
        .partitionBy("entity_type_id")
        .parquet(path)
    )


def with_zoom_levels(areas: DataFrame) -> DataFrame:
    """O-13: set the zoom level of counties and municipalities."""
    return areas.withColumn("zoom_level", F.expr(default_zoom_level("area_type_id", "zoom_level")))


def carry_soft_delete(rows: DataFrame, legacy: str = "legacy_deleted") -> DataFrame:
    """O-44: a row deleted under the legacy flag is deleted; the legacy column goes."""
    return rows.withColumn("is_deleted", F.expr(f"IF({legacy}, TRUE, is_deleted)")).drop(legacy)


def with_dna_basis(basis_of_records: DataFrame) -> DataFrame:
    """O-45: append the DNA rows to the basis-of-record lookup."""
    rows = ", ".join(
        f"struct({i} AS basis_of_record_id, {quoted(name)} AS name, {quoted(text)} AS description, "
        f"{quoted(variants)} AS variants, CAST(NULL AS INT) AS observation_count, FALSE AS is_deleted)"
        for i, name, text, variants in codes.DNA_BASIS_ROWS
    )
    appended = basis_of_records.sparkSession.range(1).selectExpr(f"inline(array({rows}))")
    return basis_of_records.unionByName(appended)
