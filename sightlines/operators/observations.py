"""Observation list with look-ahead paging (O-51, O-64a, O-64b, O-64m)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.operators.filters import (
    ObservationFilter,
    apply_filters,
    distinct_ids,
    geography_condition,
    institution_condition,
)
from sightlines.sources.shared import stored
from sightlines.sources.tables import OccurrenceTables

# Cells that a search for a key counts per round, and rows among which the key is then picked.
KEY_CELLS, FEW_ROWS = 1_024, 10_000
# Windows that end within so many rows are a top-k.
TOP_ROWS = 4_096

_PAGE_COLUMNS = (
    "observation_id", "taxon_id", "location_id", "taxon_group_id", "category_id", "date_time_collected",
    "coordinate_precision_m",
)


def page_bounds(f: ObservationFilter, lookahead: int = codes.LOOKAHEAD_PAGES) -> tuple[int, int]:
    """O-64a: (rows to skip, rows to take)."""
    if not f.is_paginated:
        return 0, codes.DEFAULT_OBSERVATIONS
    return (f.page_number - 1) * f.results_per_page, f.results_per_page * lookahead


def first_rows(df: DataFrame, key: str, take: int) -> DataFrame:
    """The first rows in the order of a unique key: a top-k, which sends at most ``take`` rows per task to one task."""
    return df.orderBy(key).limit(take)


def key_at(df: DataFrame, key: str, rank: int, cells: int = KEY_CELLS, few: int = FEW_ROWS) -> int | None:
    """The key of the row with a given rank (from 0) in key order, None behind the last row. Runs jobs.

    Counts per cell of the key range (at most ``cells`` rows reach the driver) tell which cell holds the row; that cell is
    cut into cells again until it holds few rows, of which the row is picked. Exact for any distribution of
    integer keys; a round narrows the range up to ``cells`` times.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if rank >= n:
        return None
    before = 0
    while high > low and n > few:
        width = (high - low) // cells + 1
        cell = F.expr(f"(`{key}` - {low}L) div {width}L").alias("cell")
        counted = df.where(F.col(key).between(low, high)).groupBy(cell).agg(F.count("*").alias("n"))
        for number, n in sorted(tuple(row) for row in counted.collect()):
            if before + n > rank:
                break
            before += n
        low, high = low + number * width, min(high, low + (number + 1) * width - 1)
    few_rows = df.select(key).where(F.col(key).between(low, high)).orderBy(key)
    return few_rows.offset(rank - before).limit(1).first()[0]


def located_window(
    df: DataFrame, key: str, skip: int, take: int, cells: int = KEY_CELLS, few: int = FEW_ROWS
) -> DataFrame:
    """Rows ``skip`` .. ``skip + take`` in the order of the unique integer column ``key``, for pages of any depth.

    Runs jobs: the keys of the first and of the last row are searched, each by itself, and the rows between them
    filtered. Nothing is skipped row by row, and a window whose ends lie far apart costs the same.
    """
    first = key_at(df, key, skip, cells, few)
    if first is None or take <= 0:
        return df.limit(0)
    last = key_at(df, key, skip + take - 1, cells, few)
    inside = F.col(key) >= first if last is None else F.col(key).between(first, last)
    return df.where(inside).orderBy(key)


def rows_after(df: DataFrame, key: str, last: int | None, take: int) -> DataFrame:
    """O-64d: keyset form of paging, which skips nothing."""
    rows = df if last is None else df.where(F.col(key) > last)
    return rows.orderBy(key).limit(take)


def matching_ids(tables: OccurrenceTables, f: ObservationFilter) -> DataFrame:
    """Ids of all observations that a request matches.

    Under area filters, with or without institutions, a stored index names them by itself, from the partitions of
    those entity types; an observation stands once below each entity, so one entity needs no distinct. Otherwise the
    filters run over the observations, reading the columns they test.
    """
    if not _named_by_index(tables, f):
        return apply_filters(tables.observation, tables, f).select("observation_id")
    listed = tables.entity_index.where(geography_condition(f))
    found = listed.select("observation_id") if _entities(f) == 1 else distinct_ids(listed)
    if f.organization_ids:
        of_institutions = tables.entity_index.where(institution_condition(f))
        found = found.join(distinct_ids(of_institutions), "observation_id", "left_semi")
    return found


def _entities(f: ObservationFilter) -> int:
    return sum(map(len, (f.municipality_ids, f.county_ids, f.restricted_area_ids, f.ocean_area_ids)))


def page_ids(tables: OccurrenceTables, f: ObservationFilter) -> DataFrame:
    """Ids of the look-ahead window of a request (at most 40 000: four pages of 10 000 rows).

    With bitmaps that answer the request, their directory finds the window (one job). Else a window near the beginning
    is a top-k, and one further down is located by key, which runs jobs over the matching ids, stored once. Where the index
    lists an id once for each chosen entity, as many rows as the window has ids and entities hold the window: a top-k
    goes before the distinct.
    """
    f.validate_page()
    skip, take = page_bounds(f)
    if tables.bitmaps is not None and tables.bitmaps.answers(f):
        return tables.bitmaps.window(f, skip, take)
    if skip and skip + take <= TOP_ROWS:
        ids = first_rows(matching_ids(tables, f), "observation_id", skip + take)
        return ids.offset(skip)
    if skip:
        return located_window(stored(matching_ids(tables, f), "matching_ids"), "observation_id", skip, take)
    if _named_by_index(tables, f) and not f.organization_ids:
        listed = tables.entity_index.where(geography_condition(f)).select("observation_id")
        return first_rows(first_rows(listed, "observation_id", take * _entities(f)).distinct(), "observation_id", take)
    return first_rows(matching_ids(tables, f), "observation_id", take)


def _named_by_index(tables: OccurrenceTables, f: ObservationFilter) -> bool:
    return tables.has_stored_index and f.has_geography and f.anywhere().but(organization_ids=()).matches_all


def _page_of(tables: OccurrenceTables, f: ObservationFilter, ids: DataFrame) -> DataFrame:
    """The observations of a window, fetched by a broadcast of its ids, which come from ``page_ids`` alone."""
    rows = tables.observation.select(*_PAGE_COLUMNS)
    if _named_by_index(tables, f):
        # Finding the bounds is cheap here; they let the scan skip row groups of a
        # table that is stored in id order.
        low, high = (ids.agg(bound("observation_id")).scalar() for bound in (F.min, F.max))
        rows = rows.where(F.col("observation_id").between(low, high))
    return rows.join(F.broadcast(ids), "observation_id", "left_semi")


def observation_rows(page: DataFrame, tables: OccurrenceTables) -> DataFrame:
    """O-64m: the eleven list columns for any observations."""
    return _observation_rows(page, tables, page.select("observation_id"))


def covering_pairs(tables: OccurrenceTables, ids: DataFrame | None = None) -> DataFrame:
    """(observation_id, institution, municipality_id) of observations in the index, of ``ids`` or of all."""
    entries = tables.entity_index.where(f"entity_type_id IN ({codes.INSTITUTION}, {codes.MUNICIPALITY})").select(
        "observation_id", "entity_type_id", "entity_id"
    )
    if ids is not None:
        entries = entries.join(ids, "observation_id", "left_semi")
    names = tables.organization.selectExpr("organization_id AS entity_id", "name AS org_name")
    entries = entries.join(names, "entity_id", "left")
    named_institution = f"entity_type_id = {codes.INSTITUTION} AND org_name IS NOT NULL"
    return entries.groupBy("observation_id").agg(
        F.expr(f"min_by(org_name, IF({named_institution}, entity_id, NULL)) AS institution"),
        F.expr(
            f"CAST(min(IF(entity_type_id = {codes.MUNICIPALITY}, entity_id, NULL)) AS STRING) AS municipality_id"
        ),
    )


def _observation_rows(page: DataFrame, tables: OccurrenceTables, ids: DataFrame) -> DataFrame:
    """``ids`` are those of the page; with a broadcast hint only if they come from ``page_ids``. The index is read once
    for both the institution and the municipality. Each takes the smallest entity id (T-08).
    """
    lookups = tables.covering if tables.covering is not None else covering_pairs(tables, ids)
    taxa = tables.taxon.select(
        "taxon_id", "preferred_popular_name", "valid_scientific_name", "valid_scientific_name_authorship"
    )
    return (
        page.join(taxa, "taxon_id")
        .join(tables.location.select("location_id", "locality"), "location_id", "left")
        .join(lookups, "observation_id", "left")
        .selectExpr(
            "observation_id",
            "preferred_popular_name",
            "valid_scientific_name AS scientific_name",
            "valid_scientific_name_authorship AS author",
            "institution",
            "locality",
            "municipality_id",
            "taxon_group_id",
            "category_id",
            "date_time_collected",
            "coordinate_precision_m",
        )
    )


def observations(tables: OccurrenceTables, f: ObservationFilter = ObservationFilter()) -> DataFrame:
    """Observation list: all observations that match, in id order, with the list columns."""
    page = tables.observation.select(*_PAGE_COLUMNS)
    if not f.matches_all:
        page = page.join(matching_ids(tables, f), "observation_id", "left_semi")
    return observation_rows(page, tables).orderBy("observation_id")


def requested_observations(tables: OccurrenceTables, f: ObservationFilter = ObservationFilter()) -> DataFrame:
    """O-64a, the request's rule: the page asked for and its look-ahead, or the first rows when no page is given.

    The window is decided on ids alone; wide columns and the joins for display follow for its rows only. The
    broadcast of the ids serves both the observations and the index.
    """
    ids = page_ids(tables, f)
    rows = _observation_rows(_page_of(tables, f, ids), tables, F.broadcast(ids))
    # The limit drops nothing; with it, the final order is a top-k instead of a range shuffle.
    _, take = page_bounds(f)
    return rows.orderBy("observation_id").limit(take)


def page_meta(window: DataFrame, f: ObservationFilter, lookahead: int = codes.LOOKAHEAD_PAGES) -> DataFrame:
    """O-64b: one row describing the look-ahead window of a paged request."""
    per_page = f.results_per_page
    return window.agg(F.count("*").alias("n")).selectExpr(
        f"{f.page_number} AS page_number",
        f"{per_page} AS results_per_page",
        f"least(n, {per_page}) AS items",
        f"greatest((n + {per_page - 1}) div {per_page} - 1, 0L) AS lookahead_count",
        f"n >= {per_page * lookahead} AS has_more_pages",
    )
