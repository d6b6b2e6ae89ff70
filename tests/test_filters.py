"""Filters and their traps on tiny tables."""

from __future__ import annotations

from datetime import datetime

import pytest

from sightlines.functions.scalars import parse_entity_ids
from sightlines.operators.filters import Envelope, ObservationFilter, apply_filters, by_envelope
from sightlines.operators.locations import locations
from tests.conftest import area, location, observation, values


@pytest.fixture(scope="module")
def tables(make):
    tags = [(2, 5), (3, 6), (4, 3), (5, 5), (5, 6)]
    return make.tables(
        observation=[
            observation(1, 1, taxon_group_id=10, date_time_collected=datetime(2020, 12, 31, 23, 59, 59)),
            observation(2, 2, category_id=None, date_time_collected=datetime(2020, 12, 31, 23, 59, 59, 500000)),
            observation(3, 3, coordinate_precision_m=None, catalog_number="A_1"),
            observation(4, 4, coordinate_precision_m=100, catalog_number="AB1", collection_code="Fish%"),
            observation(5, 5, date_time_collected=datetime(2019, 5, 1), taxon_id=2, matched_scientific_name_id=2),
            observation(6, 99),
        ],
        location=[location(k) for k in range(1, 6)],
        observation_tag=[{"observation_id": o, "tag_id": t} for o, t in tags],
        observation_behavior=[{"observation_id": o, "behavior_id": b} for o, b in [(1, 7), (1, 8), (4, 8)]],
        media_file=[{"media_file_id": 1, "observation_id": 1}, {"media_file_id": 2, "observation_id": 1},
                    {"media_file_id": 3, "observation_id": None}],
        organization=[
            {"organization_id": 1, "name": "Natural Museum", "organization_type_id": 1, "is_deleted": False},
            {"organization_id": 2, "name": "Bird Atlas", "organization_type_id": 3, "is_deleted": False},
        ],
        organization_relation=[{"observation_id": o, "organization_id": g} for o, g in [(1, 1), (2, 2), (3, 1), (3, 2)]],
        taxon=[
            {"taxon_id": 1, "preferred_popular_name": "Blåmeis", "is_deleted": False},
            {"taxon_id": 2, "preferred_popular_name": "Great tit", "is_deleted": False},
        ],
        taxon_name=[
            {"taxon_name_id": 1, "taxon_id": 1, "scientific_name": "Cyanistes caeruleus",
             "scientific_name_authorship": "(Linnaeus, 1758)", "is_deleted": False},
            {"taxon_name_id": 2, "taxon_id": 2, "scientific_name": "Parus major",
             "scientific_name_authorship": "Linnaeus, 1758", "is_deleted": False},
        ],
        area=[
            area(10, "0301", "Town", 1, 2, parent_fid="3"),
            area(20, "3", "County", 2, 1),
            area(30, "Naturbase VV00000012", "Reserve", 3, 3),
            area(40, "91", "Sea", 4, 1),
            area(60, "21_00", "Islands", 6, 1),
            area(70, "15_2017", "Old county", 2, 1, is_current=False),
        ],
        location_area=[{"location_id": p, "area_id": a} for p, a in
                       [(1, 10), (1, 20), (2, 20), (2, 70), (3, 30), (4, 40), (5, 60), (99, 20)]],
    )


def ids(tables, mode="search", route="auto", **fields):
    f = ObservationFilter(**fields)
    return sorted(values(apply_filters(tables.observation, tables, f, mode, route), "observation_id"))


def test_no_filter_keeps_everything(tables):
    assert ids(tables) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize(
    "fields, expected",
    [
        ({"taxon_group_ids": [10]}, [1]),
        ({"category_ids": [1]}, [1, 3, 4, 5, 6]),
        ({"basis_of_record_ids": [2]}, []),
        ({"precision_from": 25, "precision_to": 25}, [1, 2, 5, 6]),
        ({"precision_from": 100}, [4]),
        ({"months": [5]}, [5]),
        ({"behavior_ids": [7, 8]}, [1, 4]),
        ({"with_images": True}, [1]),
        ({"with_images": False}, [2, 3, 4, 5, 6]),
        ({"registration_status_id": 1}, [1, 4, 6]),
        ({"registration_status_id": 2}, [2, 5]),
        ({"registration_status_id": 3}, [3, 5]),
        ({"registration_status_id": 9}, [1, 2, 3, 4, 5, 6]),
        ({"project_organization_id": 2, "project_name": "museum"}, [2, 3]),
        ({"project_name": " MUSEUM "}, [1, 3]),
        ({"project_name": "   "}, [1, 2, 3, 4, 5, 6]),
        ({"organization_ids": [1, 2]}, [1, 3]),
        ({"preferred_popular_name": "BLÅM"}, [1, 2, 3, 4, 6]),
        ({"preferred_popular_name": "blam"}, []),
        ({"scientific_name": "parus", "author": "linn"}, [5]),
    ],
)
def test_single_filters(tables, fields, expected):
    assert ids(tables, **fields) == expected


def test_period_ends_at_the_last_second(tables):
    assert ids(tables, period_to=2020) == [1, 5]
    assert ids(tables, period_from=2020) == [1, 2]


def test_wildcards_are_literal(tables):
    assert ids(tables, catalog_number="a_1") == [3]
    assert ids(tables, collection_code="%") == [4]
    assert ids(tables, catalog_number="[") == []
    assert ids(tables, catalog_number="it's \\ odd") == []


@pytest.mark.parametrize("route", ["index", "location"])
@pytest.mark.parametrize(
    "fields, expected",
    [
        ({"municipality_ids": ["301"]}, [1]),
        ({"municipality_ids": ["0301"], "ocean_area_ids": ["91"]}, [1, 4]),
        ({"county_ids": ["3"]}, [1, 2]),
        ({"county_ids": ["21_00"]}, [5]),
        ({"county_ids": ["15_2017"]}, []),
        ({"restricted_area_ids": ["Naturbase VV00000012"]}, [3]),
        ({"municipality_ids": ["none"]}, []),
        ({"municipality_ids": ["none"], "county_ids": ["3"]}, [1, 2]),
    ],
)
def test_geography_is_any_of_the_areas(tables, route, fields, expected):
    assert ids(tables, route=route, **fields) == expected


def test_institutions_narrow_areas_in_search_and_widen_them_in_export(tables):
    fields = {"county_ids": ["3"], "organization_ids": [1]}
    assert ids(tables, **fields) == [1]
    assert ids(tables, mode="export", **fields) == [1, 2, 3]


def test_export_mode_ignores_what_exports_ignore(tables):
    assert ids(tables, mode="export", registration_status_id=2) == [1, 2, 3, 4, 5, 6]
    assert ids(tables, mode="export", with_images=True, catalog_number="a_1", project_name="x") == [1, 2, 3, 4, 5, 6]
    assert ids(tables, mode="export", county_ids=["21_00"]) == []
    with pytest.raises(ValueError):
        ids(tables, mode="other")


def test_envelope_truncates_towards_zero(tables):
    inside = by_envelope(tables.observation, tables, Envelope(1001.9, 2001.9, 1003.9, 2003.1))
    assert sorted(values(inside, "observation_id")) == [1, 2, 3]


def test_missing_location_row_drops_out_of_locations(tables):
    assert sorted(values(locations(tables), "location_id")) == [1, 2, 3, 4, 5]


def test_limits():
    ObservationFilter(taxon_group_ids=range(500)).validate()
    with pytest.raises(ValueError, match="taxon_group_ids"):
        ObservationFilter(taxon_group_ids=range(501)).validate()
    with pytest.raises(ValueError):
        ObservationFilter(precision_from=10, precision_to=5).validate()
    # Checked only when both ends are above zero.
    ObservationFilter(precision_from=10, precision_to=0).validate()
    for page, rows in ((1, None), (None, 10), (0, 10), (1, 0), (1, 10_001)):
        with pytest.raises(ValueError):
            ObservationFilter(page_number=page, results_per_page=rows).validate_page()
    for limit in (0, 100_001):
        with pytest.raises(ValueError):
            ObservationFilter(max_results=limit).validate_locations()
    with pytest.raises(ValueError):
        ObservationFilter(envelope=Envelope(1, 1, 1, 2)).validate_locations()


def test_limits_hold_before_planning(tables):
    with pytest.raises(ValueError):
        ids(tables, taxon_group_ids=range(501))


def test_which_filters_need_dynamic_counts():
    assert not ObservationFilter().is_active()
    only_areas = ObservationFilter(county_ids=["3"])
    assert only_areas.is_active() and not only_areas.needs_dynamic_counts()
    assert ObservationFilter(restricted_area_ids=["x"]).needs_dynamic_counts()
    months = ObservationFilter(months=[5])
    assert months.is_active() and months.needs_dynamic_counts()
    assert not months.is_active(compat=True)
    assert ObservationFilter(with_images=False).needs_dynamic_counts()
    assert not ObservationFilter(project_name="  ").is_active()
    assert ObservationFilter(behavior_ids=[1]).needs_observation_rows
    assert not ObservationFilter(taxon_group_ids=[1]).needs_observation_rows


def test_fids_become_numbers():
    assert parse_entity_ids(("0301", "15_2017", "x", " 7 ", "99999999999")) == [301, 152017, 7]
    assert parse_entity_ids(("Naturbase VV00001897", "VV1"), "Naturbase VV") == [1897]
