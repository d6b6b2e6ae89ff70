"""Area selection, counting strategies, markers and hierarchy."""

from __future__ import annotations

import pytest

from sightlines.operators import areas as A
from sightlines.operators.filters import ObservationFilter
from tests.conftest import area, location, observation, plan_of, values


@pytest.fixture(scope="module")
def tables(make):
    shape = "POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))"
    return make.tables(
        observation=[observation(k, p, taxon_group_id=g) for k, p, g in [(1, 1, 5), (2, 1, 5), (3, 2, 5), (4, 3, 6)]],
        location=[location(k) for k in (1, 2, 3)],
        area=[
            area(1, "3", "Oslo", 2, 1, observation_count=100, wkt_polygon=shape),
            area(2, "11", "Rogaland", 2, 1, observation_count=200),
            area(3, "301", "Oslo", 1, 2, parent_fid="3", observation_count=100, wkt_polygon=shape),
            area(4, "1101", "Eigersund", 1, 2, parent_fid="11", observation_count=50),
            area(5, "1103", "Stavanger", 1, 2, parent_fid="11", observation_count=150),
            area(6, "91", "Sea", 4, 1, observation_count=7),
            area(7, "21_00", "Islands", 6, 1, observation_count=0),
            area(8, "Naturbase VV001", "Reserve", 3, 3, observation_count=3),
            area(9, "1199", "Former", 1, 2, parent_fid="11", observation_count=9, is_current=False),
            area(10, "92", "Sea", 4, 3, observation_count=1, wkt_polygon=shape),
        ],
        location_area=[{"location_id": p, "area_id": a} for p, a in
                       [(1, 1), (1, 3), (2, 2), (2, 4), (3, 2), (3, 5), (3, 8), (3, 6)]],
        observation_behavior=[{"observation_id": 3, "behavior_id": 1}],
    )


def counts(tables, zoom, compat=False, **fields):
    return dict(values(A.area_counts(tables, zoom, ObservationFilter(**fields), compat), "fid", "observation_count"))


def test_stored_counts_without_filters(tables):
    assert counts(tables, 1) == {"3": 100, "11": 200, "91": 7, "92": 1}
    assert counts(tables, 2) == {"301": 100, "1101": 50, "1103": 150, "91": 7, "92": 1}


def test_county_selection_keeps_stored_counts(tables):
    assert counts(tables, 2, county_ids=["11"]) == {"1101": 50, "1103": 150}
    assert counts(tables, 1, county_ids=["11"]) == {"11": 200}


def test_municipality_selection_rolls_up_at_county_level(tables):
    assert counts(tables, 1, municipality_ids=["1101", "301"]) == {"3": 100, "11": 50}
    assert counts(tables, 2, municipality_ids=["1101"]) == {"1101": 50}


def test_dynamic_counts(tables):
    assert counts(tables, 1, taxon_group_ids=[5]) == {"3": 2, "11": 1}
    assert counts(tables, 2, taxon_group_ids=[6]) == {"1103": 1, "91": 1}
    assert counts(tables, 1, behavior_ids=[1]) == {"11": 1}
    assert counts(tables, 3, taxon_group_ids=[6]) == {}  # restricted areas have no numeric fid
    assert counts(tables, 1, restricted_area_ids=["Naturbase VV001"]) == {"11": 1, "91": 1}


def test_empty_selection(tables):
    assert counts(tables, 1, municipality_ids=["777"]) == {}
    # With dynamic counts an empty selection falls back to all areas, still under the area filter.
    assert counts(tables, 1, municipality_ids=["1103"], taxon_group_ids=[6]) == {"11": 1}
    assert counts(tables, 1, ocean_area_ids=["777"], taxon_group_ids=[6]) == {}
    shown = A._chosen_areas(tables, 1, ObservationFilter(ocean_area_ids=["777"], taxon_group_ids=[6]), False)
    assert shown.count() == A.load_areas(tables, 1).count()


def test_months_alone(tables):
    assert counts(tables, 1, months=[5]) == {}
    assert counts(tables, 1, compat=True, months=[5]) == {"3": 100, "11": 200, "91": 7, "92": 1}


def test_markers_merge_names_and_prefer_polygons(tables):
    rows = values(A.area_markers(tables, 1), "marker_id", "fid", "name", "observation_count")
    assert sorted(rows) == [(1, "3", "Oslo", 100), (2, "11", "Rogaland", 200), (6, "92", "Sea", 8)]


def test_unfiltered_count_response_reuses_markers(tables):
    got = dict(values(A.counts_response(tables, 1), "fid", "observation_count"))
    assert got == {"3": 100, "11": 200, "92": 8}


def test_missing_ocean_areas_are_appended(tables):
    f = ObservationFilter(ocean_area_ids=["91", "92"])
    assert sorted(values(A.load_areas(tables, 3, f), "fid")) == ["91", "92", "Naturbase VV001"]


def test_selection_includes_parents_and_children(tables):
    f = ObservationFilter(municipality_ids=["1101"], county_ids=["3"], ocean_area_ids=["91"])
    assert sorted(values(A.select_areas(A.load_areas(tables, 1, f), tables, f), "fid")) == ["11", "3", "91"]
    assert sorted(values(A.select_areas(A.load_areas(tables, 2, f), tables, f), "fid")) == ["1101", "301", "91"]


def test_zero_fill_keeps_chosen_areas(tables):
    f = ObservationFilter(county_ids=["11"], municipality_ids=["301"])
    dynamic = A.area_counts(tables, 2, f.but(taxon_group_ids=(6,)))
    merged = A.merge_counts(A.load_areas(tables, 2), dynamic, f)
    assert sorted(values(merged, "fid", "observation_count")) == [("1103", 1), ("301", 0)]


def test_hierarchy(tables):
    assert sorted(values(A.county_municipalities(tables.area), "county_fid", "municipality_fids")) == [
        ("11", ["1101", "1103"]), ("3", ["301"]),
    ]
    assert sorted(values(A.prefix_groups(tables.area), "county_fid", "municipality_fid")) == [
        ("11", "1101"), ("11", "1103"), ("3", "301"),
    ]


@pytest.mark.parametrize(
    "municipalities, counties, expected",
    [
        (("301",), (), [("county", "3")]),
        (("1101",), (), [("municipality", "1101")]),
        (("1101", "1103", "301"), (), [("county", "11"), ("county", "3")]),
        (("1101",), ("21_00",), [("county", "21_00"), ("municipality", "1101")]),
        ((), (), []),
    ],
)
def test_full_counties_collapse(tables, municipalities, counties, expected):
    got = A.collapse_selection(tables.area, municipalities, counties)
    assert sorted(values(got, "level", "fid")) == expected


def test_counting_aggregates_the_index_before_the_areas(stored):
    plan = plan_of(A.area_counts(stored, 1, ObservationFilter(taxon_group_ids=(1, 2))))
    assert "Scan parquet" in plan and "observation_id" not in plan.split("(1) ")[0]
    assert "Cartesian" not in plan and "Python" not in plan
