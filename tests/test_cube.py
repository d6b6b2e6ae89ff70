"""The data cube against counts from the index."""

from __future__ import annotations

import datetime
import random

import pytest

from sightlines.operators import areas
from sightlines.operators import cube as C
from sightlines.operators.filters import ObservationFilter
from tests.conftest import area, location, observation, plan_of

MOMENTS = [None, datetime.datetime(1999, 12, 31, 23, 59, 59), datetime.datetime(1999, 12, 31, 23, 59, 59, 1),
           datetime.datetime(2000, 1, 1), datetime.datetime(2001, 6, 5, 4)]


def _observations(seed, ids):
    r = random.Random(seed)
    return [
        observation(i, r.choice([1, 2, 3, None]), taxon_group_id=r.choice([1, 2, 3]), category_id=r.choice([9, 11, None]),
                    basis_of_record_id=r.choice([1, 2]), date_time_collected=r.choice(MOMENTS))
        for i in ids
    ]


@pytest.fixture(scope="module")
def tables(make):
    return make.tables(
        observation=_observations(3, range(1, 80)),
        location=[location(k) for k in (1, 2, 3)],
        location_area=[{"location_id": a, "area_id": b} for a, b in [(1, 10), (1, 20), (2, 11), (2, 20), (3, 40)]],
        area=[area(10, "201", "Asker", 1, 2), area(11, "202", "Moss", 1, 2), area(20, "2", "Viken", 2, 1), area(40, "94", "Sea", 4, 1)],
        observation_tag=[{"observation_id": i, "tag_id": 5 + i % 2} for i in range(1, 80, 5)],
        media_file=[{"media_file_id": i, "observation_id": i} for i in range(1, 80, 3)],
    )


@pytest.fixture(scope="module")
def cubed(tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube") / "all")
    C.write_cube(C.base_cells(tables.enriched_index), path, files=3)
    return tables.with_cube(path)


REQUESTS = [
    {"taxon_group_ids": [1, 3]}, {"category_ids": [9]}, {"basis_of_record_ids": [2], "months": [12]}, {"period_to": 1999},
    {"period_from": 2000}, {"period_from": 1999, "period_to": 1999, "months": [12, 1]}, {"months": [1, 6]},
    {"registration_status_id": 2}, {"registration_status_id": 7}, {"with_images": True}, {"with_images": False},
    {"taxon_group_ids": [1, 2], "category_ids": [11], "registration_status_id": 1, "with_images": False, "period_from": 1999},
    {"taxon_group_ids": [2], "precision_to": 25}, {"taxon_group_ids": [2], "county_ids": ["2"]},
]


@pytest.mark.parametrize("fields", REQUESTS)
def test_counts_equal_those_of_the_index(tables, cubed, fields):
    f = ObservationFilter(**fields)
    for zoom in (1, 2):
        found, expected = (sorted(map(tuple, areas.area_counts(t, zoom, f).collect())) for t in (cubed, tables))
        assert found == expected


def test_what_cells_answer(cubed):
    answers = lambda **fields: cubed.cube.answers(ObservationFilter(**fields))
    assert answers(taxon_group_ids=[1], months=[2], with_images=True) and answers()
    assert not (answers(precision_to=5) or answers(county_ids=["2"]) or answers(behavior_ids=[1]) or answers(catalog_number="x"))
    assert not (answers(author="x") or answers(organization_ids=[2]))


def test_smallest_cuboid(cubed):
    sizes = {dimensions: cells for _, dimensions, cells in cubed.cube.cuboids()}
    for fields in REQUESTS[:12]:
        f = ObservationFilter(**fields)
        chosen = C.CUBOIDS[cubed.cube.chosen(f)]
        needed = set(C.conditions_of(f))
        assert sizes[chosen] == min(n for d, n in sizes.items() if needed <= set(d))
    assert C.CUBOIDS[cubed.cube.chosen(ObservationFilter(taxon_group_ids=[1]))] != C.CUBOIDS[0]


def test_only_one_cuboid_is_read(cubed):
    plan = plan_of(areas.area_counts(cubed, 1, ObservationFilter(category_ids=[9])))
    number = cubed.cube.chosen(ObservationFilter(category_ids=[9]))
    assert f"(cuboid#" in plan and f"= {number})" in plan and "observation_id" not in plan


def test_changes_are_merged(make, tables, cubed, tmp_path):
    """Moved, removed and added observations; the merged cube equals one that is built anew."""
    old, new = _observations(3, range(1, 80)), _observations(4, range(60, 95))
    kept = [r for r in old if r["observation_id"] < 60]
    gone = [r for r in old if r["observation_id"] >= 60]
    frame = lambda rows: tables.with_table("observation", make.table("observation", rows))
    merged = C.changed_base(cubed.cube, frame(gone), frame(new))
    rebuilt = C.base_cells(frame(kept + new).enriched_index)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, rebuilt.collect()))
    C.write_cube(merged, str(tmp_path / "cube"), files=2)
    f = ObservationFilter(taxon_group_ids=[1, 2], period_to=2000)
    after = frame(kept + new)
    found, expected = (
        sorted(map(tuple, areas.area_counts(t, 2, f).collect())) for t in (after.with_cube(str(tmp_path / "cube")), after)
    )
    assert found == expected


def test_base_comes_first(tables, tmp_path):
    with pytest.raises(ValueError):
        C.write_cube(C.base_cells(tables.enriched_index), str(tmp_path / "x"), cuboids=(("category_id",),))


def test_cells_are_added_up_where_they_are(tables):
    """No exchange carries a row for each cell and cuboid."""
    plan = plan_of(C.cuboid_cells(C.base_cells(tables.enriched_index)))
    assert "Expand" not in plan and "Exchange" not in plan[: plan.index("Generate")]
