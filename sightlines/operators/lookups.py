"""Lookup lists and trees (O-18, O-61, O-62, O-64e, O-64i .. O-64k).

Sorting is by code point; ``collation`` names a Spark collation for another
order, for example ``nb_CI`` (T-06).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.functions.scalars import category_rank
from sightlines.operators.text_index import with_text
from sightlines.sources.tables import OccurrenceTables


def _sort_name(name: str, collation: str | None) -> Column:
    return F.col(name) if collation is None else F.collate(F.col(name), collation)


def _kept(df: DataFrame) -> DataFrame:
    return df.where("NOT is_deleted")


def category_rows(tables: OccurrenceTables) -> DataFrame:
    """Category types with their categories, one row each; a type without categories has nulls."""
    types = _kept(tables.category_type).select("category_type_id", F.col("name").alias("type_name"))
    categories = _kept(tables.category).select(
        "category_type_id", "category_id", "code", F.col("name").alias("category_name"), "observation_count"
    )
    return types.join(categories, "category_type_id", "left")


def category_tree(tables: OccurrenceTables) -> DataFrame:
    """O-61: category types by name, each with its categories sorted by name; empty lists stay.

    Categories are a fixed code list, so a type's list is short.
    """
    member = F.struct(
        F.col("category_name").alias("name"), "category_id", "code", "observation_count"
    )
    return (
        category_rows(tables)
        .groupBy("category_type_id", "type_name")
        .agg(F.sort_array(F.collect_list(F.when(F.col("category_id").isNotNull(), member))).alias("categories"))
        .orderBy("type_name")
    )


def ordered_categories(tables: OccurrenceTables) -> DataFrame:
    """O-18: undeleted categories with their display rank."""
    return (
        _kept(tables.category)
        .selectExpr("category_id", "code", "name", f"{category_rank('code')} AS display_rank")
        .orderBy("display_rank", "category_id")
    )


def area_rows(tables: OccurrenceTables) -> DataFrame:
    """Area types with their current areas, one row each; the form for large area sets."""
    types = _kept(tables.area_type).select("area_type_id", F.col("name").alias("type_name"))
    areas = _kept(tables.area).where("is_current").select(
        "area_type_id", "area_id", "fid", F.col("name").alias("area_name"), "observation_count"
    )
    return types.join(areas, "area_type_id", "left")


def area_tree(tables: OccurrenceTables) -> DataFrame:
    """O-61: area types by name, each with its current areas sorted by name.

    Lists of one dimension's members, without polygons; ``area_rows`` has the same
    content without nesting.
    """
    member = F.struct(F.col("area_name").alias("name"), "area_id", "fid", "observation_count")
    return (
        area_rows(tables)
        .groupBy("area_type_id", "type_name")
        .agg(F.sort_array(F.collect_list(F.when(F.col("area_id").isNotNull(), member))).alias("areas"))
        .orderBy("type_name")
    )


AREA_SLOTS = {
    "counties": codes.COUNTY,
    "municipalities": codes.MUNICIPALITY,
    "restricted_areas": codes.RESTRICTED_AREA,
    "ocean_areas": codes.OCEAN_AREA,
    "polar_islands": codes.POLAR_ISLANDS,
}


def area_slots(tables: OccurrenceTables) -> DataFrame:
    """O-62: the area tree as one row with five named slots; a missing type is null."""
    kind = F.struct("type_name", "areas")
    return area_tree(tables).agg(
        *[F.first(F.when(F.col("area_type_id") == t, kind), ignorenulls=True).alias(n) for n, t in AREA_SLOTS.items()]
    )


def institutions(tables: OccurrenceTables, collation: str | None = None) -> DataFrame:
    """O-64i: institutions with observations, by name."""
    return (
        _kept(tables.organization)
        .where(f"organization_type_id = {codes.INSTITUTION_ORGANIZATION_TYPE} AND observation_count > 0")
        .orderBy(_sort_name("name", collation), "organization_id")
        .select("organization_id", "name", "code", "observation_count")
    )


def organization_search(
    tables: OccurrenceTables, name: str, max_count: int = codes.DEFAULT_ORGANIZATIONS, collation: str | None = None
) -> DataFrame:
    """O-64j: organisations whose name contains a text, by name; a blank text finds none."""
    if not 1 <= max_count <= codes.MAX_ORGANIZATIONS:
        raise ValueError(f"max_count must be between 1 and {codes.MAX_ORGANIZATIONS}")
    kept = _kept(tables.organization)
    found = with_text(kept, tables, "organization", "name", name.strip()) if name.strip() else kept.where("FALSE")
    return (
        found
        .orderBy(_sort_name("name", collation), "organization_id")
        .limit(max_count)
        .select("organization_id", "name")
    )


def _simple(df: DataFrame, key: str, columns: tuple[str, ...], collation: str | None) -> DataFrame:
    return _kept(df).orderBy(_sort_name("name", collation), key).select(key, *columns)


def taxon_groups(tables: OccurrenceTables, collation: str | None = None) -> DataFrame:
    """O-64k."""
    return _simple(tables.taxon_group, "taxon_group_id", ("name", "observation_count"), collation)


def behaviors(tables: OccurrenceTables, collation: str | None = None) -> DataFrame:
    """O-64k."""
    columns = ("name", "variants", "description", "observation_count")
    return _simple(tables.behavior, "behavior_id", columns, collation)


def basis_of_records(tables: OccurrenceTables, collation: str | None = None) -> DataFrame:
    """O-64k."""
    columns = ("name", "variants", "description", "observation_count")
    return _simple(tables.basis_of_record, "basis_of_record_id", columns, collation)


def split_variants(df: DataFrame, key: str, variants: str = "variants") -> DataFrame:
    """O-21: one row per entry of a comma-separated list column."""
    return df.select(key, F.explode(F.split(variants, ",")).alias("variant"))


def joined_variants(rows: DataFrame, key: str) -> DataFrame:
    """O-21: the entries of each key as one sorted comma-separated text."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("variant")), ",").alias("variants"))
