"""Locations, observation pages, taxon search and lookups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.operators import locations as L
from sightlines.operators import lookups, observations, taxa
from sightlines.operators.filters import Envelope, ObservationFilter
from tests.conftest import area, location, observation, plan_of, values


@pytest.fixture(scope="module")
def tables(make):
    """Three locations with 3, 2 and 1 observations; five taxa."""
    groups = [(1, 970001, 11, 920001, 25)] * 3 + [(2, 970002, 14, 920002, 100)] * 2 + [(3, 970001, 14, 920001, 500)]
    return make.tables(
        observation=[
            observation(k, p, taxon_group_id=g, category_id=c, basis_of_record_id=b, coordinate_precision_m=m)
            for k, (p, g, c, b, m) in enumerate(groups, 1)
        ],
        location=[
            location(k, east=900 + 100 * k, north=1900 + 100 * k, latitude=None if k == 3 else 59.5) for k in (1, 2, 3)
        ],
        taxon=[
            {"taxon_id": k, "valid_scientific_name": n, "is_deleted": d, "cumulative_observation_count": c,
             "exists_in_country": e, "preferred_popular_name": f"pop {n}"}
            for k, n, d, c, e in [
                (1, "repo-eksakt-art", False, 10, True), (2, "Repo-eksakt-art liten", False, None, True),
                (3, "liten repo-eksakt-art", False, 3, False), (4, "repo-eksakt-art", True, 9, True),
                (5, "repo-eksakt-art tom", False, 0, False),
            ]
        ],
        taxon_name=[
            {"taxon_name_id": k, "taxon_id": k, "scientific_name": n, "is_deleted": d}
            for k, n, d in [(1, "repo-eksakt-art", False), (2, "Repo-eksakt-art liten", False),
                            (3, "liten repo-eksakt-art", False), (4, "repo-eksakt-art", False),
                            (5, "repo-eksakt-art tom", False), (6, "zz_percent%", True)]
        ],
        taxon_popular_name=[
            {"taxon_popular_name_id": 1, "taxon_id": 3, "name": "Hare", "is_deleted": False},
            {"taxon_popular_name_id": 2, "taxon_id": 1, "name": "hare liten", "is_deleted": False},
            {"taxon_popular_name_id": 3, "taxon_id": 2, "name": "hare", "is_deleted": True},
        ],
        organization=[
            {"organization_id": k, "name": n, "code": n[:2], "organization_type_id": t, "observation_count": c,
             "is_deleted": d}
            for k, n, t, c, d in [(1, "b museum", 1, 5, False), (2, "A museum", 1, 0, False),
                                  (3, "atlas_x", 3, 9, False), (4, "old museum", 1, 5, True), (5, "a museum", 1, 2, False),
                                  (6, "null museum", 1, None, False)]
        ],
    )


def located(tables, **fields):
    return values(L.requested_locations(tables, ObservationFilter(**fields)), "location_id", "observation_count")


def test_counts_descend(tables):
    assert located(tables) == [(1, 3), (2, 2), (3, 1)]
    assert located(tables, max_results=2) == [(1, 3), (2, 2)]


@pytest.mark.parametrize(
    "fields, expected",
    [
        ({"taxon_group_ids": [970001]}, [1, 3]),
        ({"category_ids": [11]}, [1]),
        ({"basis_of_record_ids": [920001]}, [1, 3]),
        ({"precision_from": 100}, [2, 3]),
        ({"precision_to": 50}, [1]),
        ({"envelope": Envelope(1000, 2000, 1100, 2100)}, [1, 2]),
    ],
)
def test_filtered_locations(tables, fields, expected):
    assert [k for k, _ in located(tables, **fields)] == expected


def test_missing_coordinates_read_as_zero(tables):
    assert values(L.locations(tables).where("location_id = 3"), "latitude") == [0.0]


def test_location_limits():
    assert L.location_limit(0) == L.location_limit(100_001) == 100_000
    assert L.location_limit(7) == 7


def test_location_json(tables):
    assert values(L.location_document(tables, ObservationFilter(epsg=4326)), "document") == [
        '{"epsg":4326,"locations":[[1,11.75,59.5,3],[2,12.75,59.5,2],[3,13.75,0,1]]}'
    ]


@pytest.mark.parametrize(
    "n, per_page, lookahead, more",
    [(10, 10, 0, False), (25, 10, 2, False), (20, 10, 1, False), (1, 10, 0, False), (40, 10, 3, True),
     (39, 10, 3, False), (0, 10, 0, False), (100, 25, 3, True), (99, 25, 3, False)],
)
def test_page_metadata(spark, n, per_page, lookahead, more):
    f = ObservationFilter(page_number=1, results_per_page=per_page)
    row = observations.page_meta(spark.range(n), f).first()
    assert (row.lookahead_count, row.has_more_pages, row["items"]) == (lookahead, more, min(n, per_page))


@pytest.mark.parametrize("skip, take", [(0, 5), (17, 3), (990, 20), (1500, 4), (2500, 10), (2999, 40), (3000, 5)])
@pytest.mark.parametrize("spread", ["id", "id * id * 97", "IF(id < 1500, id, id + 4000000000000000000L)", "id div 1 - 5000000"])
def test_deep_pages_are_exact(spark, skip, take, spread):
    rows = spark.range(3000).selectExpr(f"CAST({spread} AS BIGINT) AS k", "id % 7 AS v")
    expected = sorted(tuple(r) for r in rows.collect())[skip : skip + take]
    got = observations.located_window(rows, "k", skip, take, cells=16, few=10)
    assert [tuple(r) for r in got.collect()] == expected
    assert "Offset" not in plan_of(got) and "TakeOrdered" not in plan_of(got)


def test_rows_after_a_key(spark):
    rows = spark.range(100)
    assert values(observations.rows_after(rows, "id", 41, 3), "id") == [42, 43, 44]
    assert values(observations.rows_after(rows, "id", None, 2), "id") == [0, 1]


def test_page_bounds():
    assert observations.page_bounds(ObservationFilter()) == (0, 20)
    assert observations.page_bounds(ObservationFilter(page_number=3, results_per_page=50)) == (100, 200)


def test_stored_and_derived_index_give_the_same_page(supplied, stored):
    f = ObservationFilter(county_ids=("1", "2"), page_number=2, results_per_page=20)
    a = [tuple(r) for r in observations.requested_observations(supplied, f).collect()]
    b = [tuple(r) for r in observations.requested_observations(stored, f).collect()]
    assert a == b and len(a) == 80
    assert a == sorted(a)


@pytest.mark.parametrize(
    "fields",
    [
        {"county_ids": ("1", "4")}, {"municipality_ids": ("201", "302"), "ocean_area_ids": ("93",)},
        {"county_ids": ("1",), "organization_ids": (2, 4, 6)}, {"restricted_area_ids": ("x",)},
    ],
)
@pytest.mark.parametrize("page", [1, 3, 40])
def test_pages_named_by_the_index_equal_filtered_ones(stored, fields, page):
    f = ObservationFilter(page_number=page, results_per_page=15, **fields)
    from sightlines.operators.filters import apply_filters

    rows = apply_filters(stored.observation, stored, f).select("observation_id")
    skip, take = observations.page_bounds(f)
    expected = values(rows.orderBy("observation_id"), "observation_id")[skip : skip + take]
    indexed = observations._page_of(stored, f, observations.page_ids(stored, f))
    assert "BroadcastHashJoin LeftSemi BuildRight" in plan_of(indexed) or not expected
    assert sorted(values(indexed, "observation_id")) == expected
    assert values(observations.requested_observations(stored, f), "observation_id") == expected


def test_taxon_search_ranks_levels(tables):
    assert values(taxa.taxon_search(tables, " REPO-eksakt-art "), "taxon_id") == [1, 2, 3]
    assert values(taxa.taxon_search(tables, "repo-eksakt-art", 1), "taxon_id") == [1]
    assert values(taxa.taxon_search(tables, "hare"), "taxon_id") == [3, 1]
    for nothing in ("  ", "zz_", "%", "tom"):
        assert values(taxa.taxon_search(tables, nothing), "taxon_id") == []
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            taxa.taxon_search(tables, "x", limit)


def test_union_form_finds_the_same_taxa(tables):
    for term in ("repo", "hare", "liten"):
        assert sorted(values(taxa.taxon_union(tables, term), "taxon_id")) == sorted(
            values(taxa.matching_taxa(tables, term), "taxon_id")
        )


def test_institutions_and_organisation_search(tables):
    assert values(lookups.institutions(tables), "organization_id") == [5, 1]
    assert values(lookups.organization_search(tables, "MUSEUM", 3), "name") == ["A museum", "a museum", "b museum"]
    assert values(lookups.organization_search(tables, "s_x"), "organization_id") == [3]
    assert values(lookups.organization_search(tables, "  "), "organization_id") == []
    with pytest.raises(ValueError):
        lookups.organization_search(tables, "x", 51)


def test_norwegian_order_on_request(make):
    tables = make.tables(taxon_group=[
        {"taxon_group_id": k, "name": n, "is_deleted": False} for k, n in [(1, "Ål"), (2, "Ærfugl"), (3, "ape"), (4, "Zebra"), (5, "Ørn")]
    ])
    assert values(lookups.taxon_groups(tables, collation="nb_CI"), "name") == ["ape", "Zebra", "Ærfugl", "Ørn", "Ål"]
    assert values(lookups.taxon_groups(tables), "name")[0] == "Zebra"


def test_trees_keep_empty_lists(make):
    tables = make.tables(
        category_type=[{"category_type_id": k, "name": n, "is_deleted": d} for k, n, d in [(1, "red", False), (2, "alien", False), (3, "x", True)]],
        category=[{"category_id": k, "name": n, "code": c, "category_type_id": 1, "is_deleted": d}
                  for k, n, c, d in [(1, "b", "CR", False), (2, "a", "LC", False), (3, "0", "XX", True)]],
        area_type=[{"area_type_id": k, "name": f"type {k}", "is_deleted": False} for k in (1, 2)],
        area=[area(1, "1", "b", 2, 1), area(2, "2", "a", 2, 1), area(3, "3", "c", 2, 1, is_current=False),
              area(4, "4", "d", 2, 1, is_deleted=True)],
    )
    tree = values(lookups.category_tree(tables), "type_name", "categories")
    assert [(n, [c.name for c in cs]) for n, cs in tree] == [("alien", []), ("red", ["a", "b"])]
    slots = lookups.area_slots(tables).first()
    assert [a.fid for a in slots.counties.areas] == ["2", "1"]
    assert slots.municipalities.areas == [] and slots.ocean_areas is None


def test_variants_split_and_join(make):
    rows = make.table("behavior", [{"behavior_id": 1, "variants": "b,a,c"}, {"behavior_id": 2, "variants": "x"}])
    parts = lookups.split_variants(rows, "behavior_id")
    assert sorted(values(parts, "behavior_id", "variant")) == [(1, "a"), (1, "b"), (1, "c"), (2, "x")]
    assert sorted(values(lookups.joined_variants(parts, "behavior_id"), "behavior_id", "variants")) == [(1, "a,b,c"), (2, "x")]


def test_category_display_order(make):
    tables = make.tables(category=[
        {"category_id": k, "code": c, "name": "n", "is_deleted": False}
        for k, c in enumerate([None, "??", *reversed(codes.CATEGORY_ORDER)])
    ])
    ordered = values(lookups.ordered_categories(tables), "code")
    assert tuple(ordered[:15]) == codes.CATEGORY_ORDER and set(ordered[15:]) == {None, "??"}


def test_plans_use_semi_joins_and_no_python(supplied):
    f = ObservationFilter(
        taxon_group_ids=(1, 2), county_ids=("3",), organization_ids=(2,), behavior_ids=(1,), registration_status_id=1,
        with_images=False, project_name="supp", preferred_popular_name="red",
    )
    plan = plan_of(L.requested_locations(supplied, f))
    assert "LeftSemi" in plan and "LeftAnti" in plan
    for unwanted in ("Cartesian", "NestedLoop", "Python", "Window"):
        assert unwanted not in plan
    assert "TakeOrderedAndProject" in plan


def test_filters_reach_the_scan(stored):
    f = ObservationFilter(taxon_group_ids=(3,), precision_from=500, period_from=1998)
    plan = plan_of(L.locations(stored, f))
    scan = next(p for p in plan.split("\n\n") if "Scan parquet" in p and "taxon_group_id" in p)
    assert "EqualTo(taxon_group_id,3)" in scan or "In(taxon_group_id, [3])" in scan
    assert "GreaterThanOrEqual(coordinate_precision_m,500)" in scan
    read = scan.split("ReadSchema:")[1]
    assert "catalog_number" not in read and "location_id" in read


def test_page_ids_are_broadcast_to_the_index(stored):
    page = observations.requested_observations(stored, ObservationFilter(page_number=1, results_per_page=10))
    plan = plan_of(page)
    assert plan.count("BroadcastHashJoin LeftSemi BuildRight") >= 2
    assert "PartitionFilters: [entity_type_id" in plan
    page.collect()
    assert "ReusedExchange" in page._jdf.queryExecution().executedPlan().toString()


def test_hot_observation_collapses_before_the_semi_join(spark, make):
    """Nearly all junction rows belong to one observation; the id set is reduced map-side."""
    tags = spark.range(0, 200_000, 1, 8).selectExpr("IF(id % 1000 = 0, id, 7) AS observation_id", "5 AS tag_id")
    tables = make.tables(location=[location(1)]).with_table("observation_tag", tags).with_table(
        "observation", spark.range(200_000).selectExpr("id AS observation_id", "1L AS location_id")
    )
    from sightlines.operators.filters import apply_filters

    matching = apply_filters(tables.observation, tables, ObservationFilter(registration_status_id=2))
    assert matching.count() == 201
    assert plan_of(matching).count("HashAggregate") >= 2
    assert tags.agg(F.count_distinct("observation_id")).first()[0] == 201
