"""The request of every named query, in one place for queries, benchmarks and tests."""

from __future__ import annotations

from sightlines.operators.filters import Envelope, ObservationFilter

REQUESTS = {
    "f_taxon_group": ObservationFilter(taxon_group_ids=(3, 7, 21)),
    "f_category": ObservationFilter(category_ids=(9, 12)),
    "f_basis": ObservationFilter(basis_of_record_ids=(1, 4)),
    "f_precision": ObservationFilter(precision_from=500, precision_to=2500),
    "f_period": ObservationFilter(period_from=1996, period_to=1999),
    "f_months": ObservationFilter(months=(5, 6, 12)),
    "f_geo_or": ObservationFilter(
        municipality_ids=("201", "0302"),
        county_ids=("3", "21_99"),
        restricted_area_ids=("Naturbase VV00005",),
        ocean_area_ids=("94",),
    ),
    "f_geo_unparsable": ObservationFilter(municipality_ids=("x1", "--")),
    "f_institution": ObservationFilter(organization_ids=(2, 4, 10)),
    "f_behavior": ObservationFilter(behavior_ids=(2, 5)),
    "f_status_1": ObservationFilter(registration_status_id=1),
    "f_status_2": ObservationFilter(registration_status_id=2),
    "f_status_3": ObservationFilter(registration_status_id=3),
    "f_media_yes": ObservationFilter(with_images=True),
    "f_media_no": ObservationFilter(with_images=False),
    "f_project_id": ObservationFilter(project_organization_id=7, project_name="ignored"),
    "f_project_name": ObservationFilter(project_name="  r#00000000 "),
    "f_collection": ObservationFilter(collection_code="2-high"),
    "f_catalog": ObservationFilter(catalog_number=" cat_12"),
    "f_like_literal": ObservationFilter(catalog_number="T_1"),
    "text_short": ObservationFilter(collection_code=" -H "),
    "f_text": ObservationFilter(preferred_popular_name="RED", scientific_name="ring", author="Eco"),
    "f_envelope": ObservationFilter(envelope=Envelope(-500.7, 6_500_000.2, 40_000.9, 6_500_700.5)),
    "f_combined_search": ObservationFilter(
        taxon_group_ids=tuple(range(1, 13)), category_ids=(9, 11), county_ids=("1", "4", "21_99"),
        organization_ids=tuple(range(2, 90, 2)), registration_status_id=1, period_from=1996, with_images=False,
        collection_code="low",
    ),
    "f_combined_export": ObservationFilter(
        taxon_group_ids=tuple(range(1, 13)), category_ids=(9, 11), county_ids=("1", "4", "21_99"),
        organization_ids=(2, 4, 10), registration_status_id=1, period_from=1996, with_images=False,
        collection_code="low",
    ),
    "locations": ObservationFilter(
        taxon_group_ids=tuple(range(1, 16)), municipality_ids=("201", "105"), county_ids=("3",), max_results=500
    ),
    "locations_envelope": ObservationFilter(
        category_ids=(9, 11), envelope=Envelope(-500.7, 6_500_000.2, 60_000.9, 6_501_200.5)
    ),
    "observations_page": ObservationFilter(
        county_ids=("1", "2"), category_ids=(9, 11), page_number=3, results_per_page=50
    ),
    "observations_default": ObservationFilter(preferred_popular_name="blue"),
    "pages_any_area": ObservationFilter(county_ids=("1", "2"), ocean_area_ids=("93",), page_number=30, results_per_page=5),
    "pages_one_area": ObservationFilter(municipality_ids=("201",), page_number=9, results_per_page=2),
    "pages_unfiltered": ObservationFilter(page_number=100, results_per_page=10),
    "pages_parts": ObservationFilter(category_ids=(9,), with_images=False, page_number=50, results_per_page=2),
    "pages_behind": ObservationFilter(category_ids=(9,), page_number=4_000_000, results_per_page=100),
    "page_meta": ObservationFilter(county_ids=("1", "2"), page_number=2, results_per_page=25),
    "area_counts_pre": ObservationFilter(county_ids=("3",)),
    "area_counts_dynamic": ObservationFilter(
        taxon_group_ids=tuple(range(1, 11)), registration_status_id=2, with_images=True, period_from=1996,
        period_to=2000, months=(1, 2, 3, 4, 5, 6, 7, 8),
    ),
    "area_counts_subquery": ObservationFilter(behavior_ids=(2,), county_ids=("2", "3"), precision_to=4000),
    "area_counts_geo": ObservationFilter(
        restricted_area_ids=("Naturbase VV00005", "Naturbase VV000010"), ocean_area_ids=("93",), category_ids=(9,)
    ),
    "area_counts_fallback": ObservationFilter(municipality_ids=("0201",), taxon_group_ids=tuple(range(1, 26))),
    "area_counts_months": ObservationFilter(months=(5,)),
    "area_markers_dynamic": ObservationFilter(taxon_group_ids=tuple(range(1, 11)), basis_of_record_ids=(1, 2)),
    "area_rollup": ObservationFilter(municipality_ids=("201", "302", "206", "307")),
    "area_select": ObservationFilter(municipality_ids=("201", "307"), county_ids=("5",), ocean_area_ids=("91",)),
    "area_zero_fill": ObservationFilter(county_ids=("1", "3"), municipality_ids=("206",), ocean_area_ids=("92",)),
    "area_ocean_append": ObservationFilter(ocean_area_ids=("91", "95")),
    "area_collapse": ObservationFilter(
        municipality_ids=("201", "206", "211", "216", "221", "302", "307"), county_ids=("21_99",)
    ),
    "export_rows": ObservationFilter(category_ids=(9, 11), county_ids=("1", "2", "3")),
    "export_summary": ObservationFilter(category_ids=(9, 11), organization_ids=(2, 4, 10)),
    "polygons": ObservationFilter(
        taxon_group_ids=tuple(range(1, 16)), max_results=300,
        envelope=Envelope(5.5, 40.0, 60_000.0, 6_500_900.0),
    ),
    "polygons_all": ObservationFilter(category_ids=(9, 11), max_results=900),
}

EXPORT_COLUMNS = (
    "id", "CollectionCode", "CatalogNumber", "DateTimeCollected", "TaxonId", "Latitude", "HasErrors",
    "MonthCollected", "YearCollected", "Detail.DatasetName", "Detail.Notes", "Detail.Locality", "Bogus",
)
TAXON_TERM = " Red B"
EXPORT_NAME = "Mine funn: blåmeis_2024"
SEARCH_PREFIX = "supplier#0000000"
