"""Area selection, counts and markers (O-50, O-52, O-53b, O-55 .. O-59, O-62b, O-62c, O-64g, O-64h).

Areas are a dimension; observations enter only through the entity index, whose
counts are aggregated before they meet the areas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.functions.scalars import any_of, entity_id, or_zero, quoted
from sightlines.operators.filters import ObservationFilter, apply_filters, chosen_locations, shared_conditions
from sightlines.operators.index import location_area_entities, observation_attributes
from sightlines.operators.locations import count_by_location
from sightlines.sources.tables import OccurrenceTables


# --- hierarchy ---------------------------------------------------------------


def hierarchy_triples(areas: DataFrame) -> DataFrame:
    """O-62c: distinct (fid, area type, parent) of current areas."""
    return areas.where("is_current").select("fid", "area_type_id", "parent_fid").distinct()


def municipality_counties(areas: DataFrame) -> DataFrame:
    """O-62c: (municipality, county) by parent fid, one county per municipality."""
    return _placed_municipalities(areas).groupBy("municipality_fid").agg(F.min("county_fid").alias("county_fid"))


def _placed_municipalities(areas: DataFrame) -> DataFrame:
    return areas.where(f"is_current AND area_type_id = {codes.MUNICIPALITY} AND parent_fid <> ''").selectExpr(
        "fid AS municipality_fid", "parent_fid AS county_fid"
    )


def county_municipalities(areas: DataFrame) -> DataFrame:
    """O-62c: the municipality list of each county."""
    return _placed_municipalities(areas).groupBy("county_fid").agg(
        F.sort_array(F.collect_set("municipality_fid")).alias("municipality_fids")
    )


def prefix_groups(areas: DataFrame) -> DataFrame:
    """O-52: counties with their municipalities by fid prefix, padded to two and four digits.

    Counties without municipalities stay, with a null municipality.
    """
    # The lookup tree behind this operator holds current, undeleted areas.
    listed = areas.where("is_current AND NOT is_deleted AND fid <> ''")
    counties = listed.where(f"area_type_id = {codes.COUNTY}").selectExpr(
        "fid AS county_fid", f"{_left_padded('fid', 2)} AS prefix"
    )
    municipalities = listed.where(f"area_type_id = {codes.MUNICIPALITY}").selectExpr(
        "fid AS municipality_fid", f"substring({_left_padded('fid', 4)}, 1, 2) AS prefix"
    )
    return counties.join(municipalities, "prefix", "left").select("county_fid", "municipality_fid")


def _left_padded(fid: str, width: int) -> str:
    """Zero-padded on the left; a longer text is kept whole."""
    return f"IF(length({fid}) < {width}, lpad({fid}, {width}, '0'), {fid})"


def _literal_fids(spark: SparkSession, fids: tuple[str, ...]) -> DataFrame:
    """The (at most 500) fids of a request as rows."""
    values = ", ".join(quoted(x) for x in fids)
    return spark.range(1).selectExpr(f"explode(CAST(array({values}) AS ARRAY<STRING>)) AS fid")


def collapse_selection(areas: DataFrame, municipality_ids: tuple[str, ...], county_ids: tuple[str, ...]) -> DataFrame:
    """O-62b: (level, fid) with which a selection is sent on.

    A county whose municipalities are all chosen replaces them; other chosen
    municipalities stay; directly chosen counties are always kept.
    """
    groups = prefix_groups(areas).selectExpr("*", f"{any_of('municipality_fid', municipality_ids)} AS chosen")
    sizes = groups.groupBy("county_fid").agg(
        F.count("municipality_fid").alias("members"), F.count_if("chosen").alias("chosen_members")
    )
    full = "members = chosen_members AND chosen_members > 0"
    collapsed = sizes.where(full).selectExpr("'county' AS level", "county_fid AS fid")
    single = (
        groups.where("chosen")
        .join(sizes.where(f"NOT ({full})"), "county_fid", "left_semi")
        .selectExpr("'municipality' AS level", "municipality_fid AS fid")
    )
    direct = _literal_fids(areas.sparkSession, county_ids).selectExpr("'county' AS level", "fid")
    return collapsed.unionByName(single).unionByName(direct).distinct()


# --- which areas -------------------------------------------------------------


def load_areas(tables: OccurrenceTables, zoom_level: int, f: ObservationFilter | None = None) -> DataFrame:
    """Current areas of a zoom level.

    Ocean areas and polar islands belong to zoom 1 and 2 alike. At other levels,
    chosen ocean areas that the level lacks are appended (O-64g).
    """
    current = tables.area.where("is_current")
    at_level = f"zoom_level = {int(zoom_level)}"
    if zoom_level in (1, 2):
        return current.where(f"{at_level} OR area_type_id IN ({codes.OCEAN_AREA}, {codes.POLAR_ISLANDS})")
    loaded = current.where(at_level)
    if f is None or not f.ocean_area_ids:
        return loaded
    missing = current.where(any_of("fid", f.ocean_area_ids)).join(
        loaded.select("fid").distinct(), "fid", "left_anti"
    )
    return loaded.unionByName(missing.select(*loaded.columns))


def _with_selected(areas: DataFrame, tables: OccurrenceTables, f: ObservationFilter) -> DataFrame:
    """Areas with a flag: chosen, below a chosen county, or above a chosen municipality."""
    chosen = f.county_ids + f.municipality_ids + f.ocean_area_ids
    direct = f"{any_of('fid', chosen)} OR {any_of('parent_fid', f.county_ids)}"
    if not f.municipality_ids:
        return areas.selectExpr("*", f"{direct} AS selected")
    derived = (
        municipality_counties(tables.area)
        .where(any_of("municipality_fid", f.municipality_ids))
        .selectExpr("county_fid AS fid", "TRUE AS derived")
        .distinct()
    )
    return areas.join(derived, "fid", "left").selectExpr(
        *areas.columns, f"{direct} OR coalesce(derived, FALSE) AS selected"
    )


def select_areas(areas: DataFrame, tables: OccurrenceTables, f: ObservationFilter) -> DataFrame:
    """O-64h: chosen areas, areas below a chosen county, and the county above a chosen municipality."""
    if not f.has_area_selection:
        return areas
    return _with_selected(areas, tables, f).where("selected").drop("selected")


def _chosen_areas(tables: OccurrenceTables, zoom_level: int, f: ObservationFilter, compat: bool) -> DataFrame:
    """Areas to show. With dynamic counts, a selection that hits no area of this
    level falls back to all areas (T-12)."""
    areas = load_areas(tables, zoom_level, f)
    if not (f.has_area_selection and f.needs_dynamic_counts(compat)):
        return select_areas(areas, tables, f)
    flagged = _with_selected(areas, tables, f)
    any_selected = flagged.where("selected").select("area_id").exists()
    return flagged.where(F.col("selected") | ~any_selected).drop("selected")


# --- counts ------------------------------------------------------------------


def dynamic_counts(tables: OccurrenceTables, areas: DataFrame, f: ObservationFilter) -> DataFrame:
    """O-55: observations per (entity type, entity id) under the filters.

    Without geography, filters the index has columns for are applied to it. An area filter, and filters on other
    columns (O-50), are answered by location instead: an area is a property of the location, so observations are counted
    per location first and the counts summed over the areas of each. Status and media are judged as the index does (T-04).
    """
    keys = areas.selectExpr("area_type_id AS entity_type_id", f"{entity_id('fid')} AS entity_id").where(
        "entity_id IS NOT NULL"
    ).distinct()
    if tables.cube is not None and tables.cube.answers(f):
        return tables.cube.entity_counts(f, keys)
    if tables.bitmaps is not None and tables.bitmaps.answers(f):
        return tables.bitmaps.entity_counts(f, keys)
    if f.needs_observation_rows or f.has_geography:
        return _counts_by_location(tables, keys, f)
    # Area types lie below the institution code, so this drops whole index partitions.
    conditions = [f"entity_type_id < {codes.INSTITUTION}", *shared_conditions(f), *_judged_by_index(f)]
    index = tables.enriched_index.where(" AND ".join(conditions))
    index = index.join(keys, ["entity_type_id", "entity_id"], "left_semi")
    return index.groupBy("entity_type_id", "entity_id").agg(F.count("*").alias("observation_count"))


def _judged_by_index(f: ObservationFilter) -> list[str]:
    conditions = []
    if f.registration_status_id is not None:
        conditions.append(f"registration_status_id = {int(f.registration_status_id)}")
    if f.with_images is not None:
        conditions.append("has_media_files" if f.with_images else "NOT has_media_files")
    return conditions


def _counts_by_location(tables: OccurrenceTables, keys: DataFrame, f: ObservationFilter) -> DataFrame:
    matching = apply_filters(tables.observation, tables, f.anywhere())
    if judged := _judged_by_index(f):
        as_indexed = observation_attributes(tables).where(" AND ".join(judged)).select("observation_id")
        matching = matching.join(as_indexed, "observation_id", "left_semi")
    entities = location_area_entities(tables).join(keys, ["entity_type_id", "entity_id"], "left_semi").distinct()
    if f.has_geography:
        entities = entities.join(chosen_locations(tables, f), "location_id", "left_semi")
    return (
        count_by_location(matching)
        .join(entities, "location_id")
        .groupBy("entity_type_id", "entity_id")
        .agg(F.sum("observation_count").alias("observation_count"))
    )


def rollup_to_counties(tables: OccurrenceTables, municipality_ids: tuple[str, ...]) -> DataFrame:
    """O-58: stored counts of chosen municipalities, summed per parent county."""
    parents = municipality_counties(tables.area)
    chosen = tables.area.where(f"is_current AND {any_of('fid', municipality_ids)}").selectExpr(
        "fid AS municipality_fid", "parent_fid", f"{or_zero('observation_count')} AS stored_count"
    )
    return (
        chosen.join(parents, "municipality_fid", "left")
        .selectExpr("coalesce(parent_fid, county_fid) AS fid", "stored_count")
        .where("fid IS NOT NULL")
        .groupBy("fid")
        .agg(F.sum("stored_count").alias("rolled_count"))
    )


def counted_areas(
    tables: OccurrenceTables, zoom_level: int, f: ObservationFilter = ObservationFilter(), compat: bool = False
) -> DataFrame:
    """O-59: the areas to show with ``area_count``, from the cheapest source that is exact.

    No attribute filter: the stored counts, or the municipality rollup when
    municipalities are chosen but none is among the areas. Otherwise the index.
    Restricted areas have no numeric fid and count zero here (T-23).
    """
    areas = _chosen_areas(tables, zoom_level, f, compat)
    columns = areas.columns
    if f.needs_dynamic_counts(compat):
        counts = dynamic_counts(tables, areas, f).withColumnRenamed("observation_count", "found_count")
        keyed = areas.selectExpr("*", "area_type_id AS entity_type_id", f"{entity_id('fid')} AS entity_id")
        counted = keyed.join(counts, ["entity_type_id", "entity_id"], "left")
        return counted.selectExpr(*columns, f"{or_zero('found_count')} AS area_count")
    stored = f"CAST({or_zero('observation_count')} AS BIGINT) AS area_count"
    if f.municipality_ids and f.is_active(compat):
        shows_municipality = areas.where(any_of("fid", f.municipality_ids)).select("area_id").exists()
        rolled = areas.join(rollup_to_counties(tables, f.municipality_ids), "fid", "left").where(
            ~shows_municipality
        )
        kept = areas.where(shows_municipality)
        return kept.selectExpr(*columns, stored).unionByName(
            rolled.selectExpr(*columns, f"{or_zero('rolled_count')} AS area_count")
        )
    return areas.selectExpr(*columns, stored)


def area_counts(
    tables: OccurrenceTables, zoom_level: int, f: ObservationFilter = ObservationFilter(), compat: bool = False
) -> DataFrame:
    """O-57: (fid, count) above zero."""
    return (
        counted_areas(tables, zoom_level, f, compat)
        .groupBy("fid")
        .agg(F.sum("area_count").alias("observation_count"))
        .where("observation_count > 0")
    )


def area_markers(
    tables: OccurrenceTables, zoom_level: int, f: ObservationFilter = ObservationFilter(), compat: bool = False
) -> DataFrame:
    """O-56: one marker per area name (T-11), described by its first area with a polygon.

    "First" is the smallest area id. Polygons join in after the aggregation.
    """
    counted = counted_areas(tables, zoom_level, f, compat)
    with_polygon = "min(IF(wkt_polygon IS NOT NULL, area_id, NULL))"
    merged = (
        counted.groupBy("name")
        .agg(
            F.sum("area_count").alias("observation_count"),
            F.min("area_id").alias("marker_id"),
            F.expr(f"coalesce({with_polygon}, min(area_id)) AS area_id"),
        )
        .where("observation_count > 0")
    )
    shape = [c for c in ("centroid_x", "centroid_y") if c in tables.area.columns]
    described = tables.area.select("area_id", "fid", "area_type_id", "parent_fid", "document_id", "wkt_polygon", *shape)
    return merged.join(described, "area_id").select(
        "marker_id", "fid", "name", "area_type_id", "parent_fid", "document_id", "observation_count", "wkt_polygon", *shape
    )


def counts_response(
    tables: OccurrenceTables, zoom_level: int, f: ObservationFilter = ObservationFilter(), compat: bool = False
) -> DataFrame:
    """What a count request returns: without filters the markers' counts, else counts per fid (T-11)."""
    if f.is_active(compat) or zoom_level not in (1, 2):
        return area_counts(tables, zoom_level, f, compat)
    return area_markers(tables, zoom_level).select("fid", "observation_count")


def merge_counts(areas: DataFrame, counts: DataFrame, f: ObservationFilter) -> DataFrame:
    """O-53b: areas of the selection with their count, zero where there is none.

    An area without observations stays only when it was chosen itself.
    """
    chosen = any_of("fid", f.county_ids + f.municipality_ids + f.ocean_area_ids)
    shown = areas.where(f"{chosen} OR {any_of('parent_fid', f.county_ids)}") if f.has_area_selection else areas
    merged = shown.drop("observation_count").join(
        counts.selectExpr("fid", "observation_count AS found"), "fid", "left"
    )
    return (
        merged.selectExpr("*", f"{or_zero('found')} AS observation_count")
        .where(f"observation_count > 0 OR {chosen}")
        .drop("found")
    )
