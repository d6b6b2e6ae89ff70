"""The benchmark workload: 50 requests over stored occurrence tables.

Observation pages under area, text and mixed filters and at growing depth, taxon
search, locations, area markers, and lookups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from sightlines.operators import areas, locations, lookups, observations, taxa
from sightlines.operators.filters import ObservationFilter
from sightlines.sources import OccurrenceTables

Request = Callable[[OccurrenceTables], DataFrame]

_TOWNS = ("201", "302", "403", "206", "307", "408", "211", "312", "413", "216", "317", "418", "100", "105", "504")
_COUNTIES, _SEAS = ("3", "1", "2"), ("91", "94", "92")
_RESERVES = ("Naturbase VV00005", "Naturbase VV000010", "Naturbase VV000015")
_MUSEUMS = (2, 4, 10)


def _page(page: int = 1, rows: int = 10, **fields: object) -> Request:
    f = ObservationFilter(page_number=page, results_per_page=rows, **fields).validate_page()
    return lambda t: observations.requested_observations(t, f)


def _locations(**fields: object) -> Request:
    f = ObservationFilter(**fields).validate_locations()
    return lambda t: locations.requested_locations(t, f)


WORKLOAD: dict[str, Request] = {
    "municipality_1": _page(municipality_ids=_TOWNS[:1]),
    "municipality_3": _page(municipality_ids=_TOWNS[:3]),
    "municipality_15": _page(municipality_ids=_TOWNS),
    "county_1": _page(county_ids=_COUNTIES[:1]),
    "county_3": _page(county_ids=_COUNTIES),
    "ocean_1": _page(ocean_area_ids=_SEAS[:1]),
    "ocean_3": _page(ocean_area_ids=_SEAS),
    "restricted_1": _page(restricted_area_ids=_RESERVES[:1]),
    "restricted_3": _page(restricted_area_ids=_RESERVES),
    "institution_1": _page(organization_ids=_MUSEUMS[:1]),
    "institution_3": _page(organization_ids=_MUSEUMS),
    "municipality_1_institution_1": _page(municipality_ids=_TOWNS[:1], organization_ids=_MUSEUMS[:1]),
    "county_1_institution_1": _page(county_ids=_COUNTIES[:1], organization_ids=_MUSEUMS[:1]),
    "ocean_1_institution_1": _page(ocean_area_ids=_SEAS[:1], organization_ids=_MUSEUMS[:1]),
    "restricted_1_institution_1": _page(restricted_area_ids=_RESERVES[:1], organization_ids=_MUSEUMS[:1]),
    "municipality_1_county_1": _page(municipality_ids=_TOWNS[:1], county_ids=_COUNTIES[:1]),
    "municipality_3_county_3_institution_3": _page(
        municipality_ids=_TOWNS[:3], county_ids=_COUNTIES, organization_ids=_MUSEUMS
    ),
    "all_area_types": _page(
        municipality_ids=_TOWNS[:3], county_ids=_COUNTIES, ocean_area_ids=_SEAS, restricted_area_ids=_RESERVES,
        organization_ids=_MUSEUMS,
    ),
    "text_popular_name": _page(preferred_popular_name="blue"),
    "text_scientific_name": _page(scientific_name="red ring"),
    "text_author": _page(author="economy"),
    "text_popular_name_municipality_1": _page(preferred_popular_name="blue", municipality_ids=_TOWNS[:1]),
    "page_1_of_50": _page(1, 50, municipality_ids=_TOWNS[:1]),
    "page_10_of_50": _page(10, 50, municipality_ids=_TOWNS[:1]),
    "page_100_of_10": _page(100, 10, municipality_ids=_TOWNS[:1]),
    "category_1_municipality_1": _page(category_ids=(9,), municipality_ids=_TOWNS[:1]),
    "category_3_municipality_3": _page(category_ids=(9, 11, 12), municipality_ids=_TOWNS[:3]),
    "behavior_1_municipality_1": _page(behavior_ids=(6,), municipality_ids=_TOWNS[:1]),
    "basis_1_municipality_1": _page(basis_of_record_ids=(1,), municipality_ids=_TOWNS[:1]),
    "precision_municipality_1": _page(precision_from=500, precision_to=2500, municipality_ids=_TOWNS[:1]),
    "period_municipality_1": _page(period_from=1997, period_to=1999, municipality_ids=_TOWNS[:1]),
    "text_category_area_period": _page(
        1, 50, preferred_popular_name="red", category_ids=(9,), municipality_ids=_TOWNS[:3], period_from=1996,
        period_to=2000,
    ),
    "taxa_exact": lambda t: taxa.taxon_search(t, "red ring", 20),
    "taxa_prefix": lambda t: taxa.taxon_search(t, "red", 20),
    "taxa_inside": lambda t: taxa.taxon_search(t, "ing", 20),
    "taxa_1000": lambda t: taxa.taxon_search(t, "a", 1000),
    "locations_all": _locations(),
    "locations_group": _locations(taxon_group_ids=(1,), max_results=500),
    "locations_precision": _locations(precision_from=1, precision_to=1000, max_results=1000),
    "locations_group_precision": _locations(
        taxon_group_ids=(1,), precision_from=1, precision_to=1000, max_results=500
    ),
    "locations_max": _locations(max_results=100_000),
    "area_markers_1": lambda t: areas.area_markers(t, 1),
    "area_markers_2": lambda t: areas.area_markers(t, 2),
    "area_counts_filtered": lambda t: areas.area_counts(t, 2, ObservationFilter(taxon_group_ids=(1, 2, 3))),
    "lookup_categories": lookups.category_tree,
    "lookup_areas": lookups.area_tree,
    "lookup_institutions": lookups.institutions,
    "lookup_taxon_groups": lookups.taxon_groups,
    "lookup_organizations": lambda t: lookups.organization_search(t, "supplier", 50),
    "lookup_basis_of_records": lookups.basis_of_records,
}
