"""Observation filters (O-23 .. O-39c).

A request is an immutable ``ObservationFilter``; an empty field means no
predicate. ``apply_filters`` turns it into column predicates, which reach the
Parquet scan, and semi or anti joins against de-duplicated id sets.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sightlines import codes
from sightlines.functions.scalars import parse_entity_ids
from sightlines.operators.text_index import with_text
from sightlines.sources.tables import OccurrenceTables


@dataclass(frozen=True)
class Envelope:
    """Map extent in the coordinate system of the location table."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float

    @property
    def is_valid(self) -> bool:
        return self.min_x < self.max_x and self.min_y < self.max_y


_LISTS = (
    "taxon_group_ids", "category_ids", "basis_of_record_ids", "organization_ids", "municipality_ids",
    "county_ids", "restricted_area_ids", "ocean_area_ids", "behavior_ids",
)


@dataclass(frozen=True)
class ObservationFilter:
    taxon_group_ids: tuple[int, ...] = ()
    category_ids: tuple[int, ...] = ()
    basis_of_record_ids: tuple[int, ...] = ()
    organization_ids: tuple[int, ...] = ()
    municipality_ids: tuple[str, ...] = ()
    county_ids: tuple[str, ...] = ()
    restricted_area_ids: tuple[str, ...] = ()
    ocean_area_ids: tuple[str, ...] = ()
    behavior_ids: tuple[int, ...] = ()
    registration_status_id: int | None = None
    precision_from: int | None = None
    precision_to: int | None = None
    period_from: int | None = None
    period_to: int | None = None
    months: tuple[int, ...] = ()
    project_name: str | None = None
    project_organization_id: int | None = None
    collection_code: str | None = None
    catalog_number: str | None = None
    with_images: bool | None = None
    # Observation list and export only.
    preferred_popular_name: str | None = None
    scientific_name: str | None = None
    author: str | None = None
    page_number: int | None = None
    results_per_page: int | None = None
    # Locations and polygons only.
    envelope: Envelope | None = None
    epsg: int = codes.DEFAULT_EPSG
    max_results: int = codes.DEFAULT_LOCATIONS

    def __post_init__(self) -> None:
        for name in (*_LISTS, "months"):
            object.__setattr__(self, name, tuple(getattr(self, name) or ()))

    def but(self, **changes: object) -> ObservationFilter:
        return dataclasses.replace(self, **changes)

    def anywhere(self) -> ObservationFilter:
        """The same request without its area and envelope filters."""
        return self.but(municipality_ids=(), county_ids=(), restricted_area_ids=(), ocean_area_ids=(), envelope=None)

    @property
    def is_paginated(self) -> bool:
        return self.page_number is not None and self.results_per_page is not None

    @property
    def matches_all(self) -> bool:
        """No predicate on observations at all."""
        texts = (self.preferred_popular_name, self.scientific_name, self.author)
        return not (self.is_active() or any(texts) or self.envelope is not None)

    @property
    def has_geography(self) -> bool:
        return bool(self.municipality_ids or self.county_ids or self.restricted_area_ids or self.ocean_area_ids)

    @property
    def has_area_selection(self) -> bool:
        """Area lists that choose which areas are shown; restricted areas do not."""
        return bool(self.county_ids or self.municipality_ids or self.ocean_area_ids)

    def needs_dynamic_counts(self, compat: bool = False) -> bool:
        """O-39: some filter makes the stored area counts unusable.

        Months alone count as such a filter; ``compat=True`` keeps the older
        behaviour in which they do not (T-03).
        """
        return (
            bool(
                self.taxon_group_ids or self.category_ids or self.basis_of_record_ids or self.organization_ids
                or self.restricted_area_ids or self.behavior_ids
            )
            or any(
                v is not None
                for v in (
                    self.registration_status_id, self.precision_from, self.precision_to, self.period_from,
                    self.period_to, self.project_organization_id, self.with_images,
                )
            )
            or any(_given(v) for v in (self.project_name, self.collection_code, self.catalog_number))
            or (bool(self.months) and not compat)
        )

    def is_active(self, compat: bool = False) -> bool:
        """O-39: at least one search filter is set."""
        return self.needs_dynamic_counts(compat) or self.has_area_selection

    @property
    def needs_observation_rows(self) -> bool:
        """Filters that the enriched entity index has no column for."""
        return bool(
            self.organization_ids or self.behavior_ids or _given(self.project_name)
            or self.project_organization_id is not None or _given(self.collection_code)
            or _given(self.catalog_number)
        )

    def validate(self) -> ObservationFilter:
        """O-39b: limits common to every request; raises ``ValueError``."""
        for name in _LISTS:
            if len(getattr(self, name)) > codes.MAX_LIST_ITEMS:
                raise ValueError(f"{name} can contain at most {codes.MAX_LIST_ITEMS} items")
        low, high = self.precision_from, self.precision_to
        if low is not None and high is not None and low > high and low > 0 and high > 0:
            raise ValueError("precision_from must be less than or equal to precision_to")
        return self

    def validate_counts(self, zoom_level: int) -> ObservationFilter:
        """O-39b for count requests, which know the zoom levels 1 and 2."""
        self.validate()
        _require_range(zoom_level, 1, 2)
        return self

    def validate_page(self) -> ObservationFilter:
        self.validate()
        if (self.page_number is None) != (self.results_per_page is None):
            raise ValueError("page_number and results_per_page must be given together")
        if self.page_number is not None and self.page_number < 1:
            raise ValueError("page_number must be at least 1")
        if self.results_per_page is not None:
            _require_range(self.results_per_page, 1, codes.MAX_OBSERVATIONS)
        return self

    def validate_locations(self) -> ObservationFilter:
        self.validate()
        _require_range(self.max_results, 1, codes.MAX_LOCATIONS)
        if self.envelope is not None and not self.envelope.is_valid:
            raise ValueError("envelope minimum must be less than its maximum")
        return self


def _given(text: str | None) -> bool:
    return text is not None and text.strip() != ""


def _require_range(value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"value must be between {low} and {high}")


def _in(column: str, values: tuple[int, ...] | list[int]) -> str:
    return f"{column} IN ({', '.join(str(int(v)) for v in values)})"


def _all(conditions: list[str]) -> str:
    return " AND ".join(f"({c})" for c in conditions) or "TRUE"


def shared_conditions(f: ObservationFilter) -> list[str]:
    """Predicates on columns that observations and the enriched index have in common
    (O-23 .. O-25, O-30 .. O-32). Nulls never match."""
    conditions = []
    if f.taxon_group_ids:
        conditions.append(_in("taxon_group_id", f.taxon_group_ids))
    if f.category_ids:
        conditions.append(_in("category_id", f.category_ids))
    if f.basis_of_record_ids:
        conditions.append(_in("basis_of_record_id", f.basis_of_record_ids))
    if f.precision_from is not None:
        conditions.append(f"coordinate_precision_m >= {int(f.precision_from)}")
    if f.precision_to is not None:
        conditions.append(f"coordinate_precision_m <= {int(f.precision_to)}")
    if f.period_from is not None:
        conditions.append(f"date_time_collected >= TIMESTAMP_NTZ '{f.period_from:04d}-01-01 00:00:00'")
    if f.period_to is not None:
        conditions.append(f"date_time_collected <= TIMESTAMP_NTZ '{f.period_to:04d}-12-31 23:59:59'")
    if f.months:
        conditions.append(_in("month(date_time_collected)", f.months))
    return conditions


def geography_condition(f: ObservationFilter, polar: bool = True) -> str:
    """O-26: index rows in any chosen area. County ids also name polar islands.

    A list whose entries are all unparsable matches no row (T-02).
    """
    counties = parse_entity_ids(f.county_ids)
    wanted = [
        (codes.MUNICIPALITY, parse_entity_ids(f.municipality_ids)),
        (codes.COUNTY, counties),
        (codes.RESTRICTED_AREA, parse_entity_ids(f.restricted_area_ids, codes.RESTRICTED_FID_PREFIX)),
        (codes.OCEAN_AREA, parse_entity_ids(f.ocean_area_ids)),
    ]
    if polar:
        wanted.append((codes.POLAR_ISLANDS, counties))
    matches = [f"(entity_type_id = {kind} AND {_in('entity_id', ids)})" for kind, ids in wanted if ids]
    return " OR ".join(matches) or "FALSE"


def institution_condition(f: ObservationFilter) -> str:
    return f"(entity_type_id = {codes.INSTITUTION} AND {_in('entity_id', f.organization_ids)})"


def distinct_ids(df: DataFrame) -> DataFrame:
    """De-duplicated ids: a key with very many rows collapses before the shuffle."""
    return df.select("observation_id").where("observation_id IS NOT NULL").distinct()


def _having(df: DataFrame, related: DataFrame) -> DataFrame:
    return df.join(distinct_ids(related), "observation_id", "left_semi")


def _without(df: DataFrame, related: DataFrame) -> DataFrame:
    return df.join(distinct_ids(related), "observation_id", "left_anti")


def chosen_locations(tables: OccurrenceTables, f: ObservationFilter, polar: bool = True) -> DataFrame:
    """Ids of the existing locations that lie in any chosen area."""
    from sightlines.operators.index import location_area_entities

    return location_area_entities(tables).where(geography_condition(f, polar)).select("location_id").distinct()


def by_geography(
    df: DataFrame, tables: OccurrenceTables, f: ObservationFilter, route: str = "auto", polar: bool = True
) -> DataFrame:
    """O-26 as a semi join.

    ``location`` asks the location dimension, whose id set is smaller than one of
    observations and often small enough to broadcast; ``index`` looks the rows up in
    the entity index by observation. Both give the same rows when the index is
    current. ``auto`` takes the location wherever the rows carry one.
    """
    if not f.has_geography:
        return df
    if route == "auto":
        route = "location" if "location_id" in df.columns else "index"
    if route == "index":
        return _having(df, tables.entity_index.where(geography_condition(f, polar)))
    return df.join(chosen_locations(tables, f, polar), "location_id", "left_semi")


def by_status(df: DataFrame, tables: OccurrenceTables, status: int | None) -> DataFrame:
    """O-29: values other than 1, 2 and 3 filter nothing."""
    if status == codes.STATUS_FOUND:
        deciding = _in("tag_id", (codes.TAG_ABSENT, codes.TAG_NOT_RECOVERED))
        return _without(df, tables.observation_tag.where(deciding))
    if status == codes.STATUS_ABSENT:
        return _having(df, tables.observation_tag.where(f"tag_id = {codes.TAG_ABSENT}"))
    if status == codes.STATUS_NOT_RECOVERED:
        return _having(df, tables.observation_tag.where(f"tag_id = {codes.TAG_NOT_RECOVERED}"))
    return df


def by_project(df: DataFrame, tables: OccurrenceTables, f: ObservationFilter) -> DataFrame:
    """O-33: the organisation id wins over the name."""
    if f.project_organization_id is not None:
        relation = tables.organization_relation.where(f"organization_id = {int(f.project_organization_id)}")
        return _having(df, relation)
    if _given(f.project_name):
        named = with_text(tables.organization, tables, "organization", "name", f.project_name.strip())
        return _having(
            df, tables.organization_relation.join(named.select("organization_id"), "organization_id", "left_semi")
        )
    return df


def by_text(df: DataFrame, tables: OccurrenceTables, f: ObservationFilter) -> DataFrame:
    """O-36: name filters on the taxon and on the matched name; not trimmed."""
    if f.preferred_popular_name:
        taxa = with_text(tables.taxon, tables, "taxon", "preferred_popular_name", f.preferred_popular_name)
        df = df.join(taxa.select("taxon_id"), "taxon_id", "left_semi")
    names = tables.taxon_name
    for column, term in (("scientific_name", f.scientific_name), ("scientific_name_authorship", f.author)):
        if term:
            names = with_text(names, tables, "taxon_name", column, term)
    if f.scientific_name or f.author:
        matched = names.selectExpr("taxon_name_id AS matched_scientific_name_id")
        df = df.join(matched, "matched_scientific_name_id", "left_semi")
    return df


def envelope_condition(envelope: Envelope) -> str:
    """O-37: inclusive bounds, truncated to integers (T-13)."""
    return (
        f"east BETWEEN {int(envelope.min_x)} AND {int(envelope.max_x)} "
        f"AND north BETWEEN {int(envelope.min_y)} AND {int(envelope.max_y)}"
    )


def inside_envelope(location: DataFrame, envelope: Envelope) -> DataFrame:
    """Locations inside; where they are stored in Z-order, the envelope's key ranges go to the scan first."""
    from sightlines.operators import zorder

    if zorder.KEY in location.columns:
        location = location.where(zorder.range_condition(envelope))
    return location.where(envelope_condition(envelope))


def by_envelope(df: DataFrame, tables: OccurrenceTables, envelope: Envelope | None) -> DataFrame:
    if envelope is None:
        return df
    inside = inside_envelope(tables.location, envelope).select("location_id")
    return df.join(inside, "location_id", "left_semi")


def apply_filters(
    observations: DataFrame,
    tables: OccurrenceTables,
    f: ObservationFilter,
    mode: str = "search",
    route: str = "auto",
) -> DataFrame:
    """All filters of a request, AND-combined.

    ``mode="export"`` keeps the narrower filter set of exports (O-39c, T-01):
    institutions are OR-ed with areas, polar islands are not matched, and status,
    project, collection, catalogue and media filters are ignored.
    """
    if mode not in ("search", "export"):
        raise ValueError(f"unknown filter mode {mode!r}")
    f.validate()
    df = observations.where(_all(shared_conditions(f)))
    if mode == "search":
        for column, term in (("collection_code", f.collection_code), ("catalog_number", f.catalog_number)):
            if _given(term):
                df = with_text(df, tables, "observation", column, term.strip())
    df = by_text(df, tables, f)
    if mode == "export":
        return _export_filters(df, tables, f, route)
    df = by_geography(df, tables, f, route)
    if f.organization_ids:
        df = _having(df, tables.entity_index.where(institution_condition(f)))
    if f.behavior_ids:
        df = _having(df, tables.observation_behavior.where(_in("behavior_id", f.behavior_ids)))
    df = by_status(df, tables, f.registration_status_id)
    df = by_project(df, tables, f)
    if f.with_images is not None:
        df = (_having if f.with_images else _without)(df, tables.media_file)
    return df


def _export_filters(df: DataFrame, tables: OccurrenceTables, f: ObservationFilter, route: str) -> DataFrame:
    if f.organization_ids:
        # Areas or institutions: only the index holds both.
        either = f"{geography_condition(f, polar=False)} OR {institution_condition(f)}"
        df = _having(df, tables.entity_index.where(either))
    else:
        df = by_geography(df, tables, f, route, polar=False)
    if f.behavior_ids:
        df = _having(df, tables.observation_behavior.where(_in("behavior_id", f.behavior_ids)))
    return df
