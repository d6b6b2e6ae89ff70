"""The entity index: rows, filter columns, repeatable backfill, storage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sightlines.operators import index
from sightlines.operators.filters import ObservationFilter
from sightlines.operators.areas import dynamic_counts, load_areas
from tests.conftest import area, location, observation, plan_of, values


@pytest.fixture(scope="module")
def tables(make):
    return make.tables(
        observation=[observation(1, 1), observation(2, 1), observation(3, None), observation(4, 9)],
        location=[location(1)],
        area=[
            area(1, "0301", "a", 1, 2), area(2, "301", "b", 1, 2), area(3, "Naturbase VV0007", "r", 3, 3),
            area(4, "no number", "bad", 2, 1), area(5, "50", "gone", 2, 1, is_current=False),
        ],
        location_area=[{"location_id": p, "area_id": a} for p, a in [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (9, 1)]],
        organization=[{"organization_id": 1, "organization_type_id": 1}, {"organization_id": 2, "organization_type_id": 3}],
        organization_relation=[{"observation_id": o, "organization_id": g} for o, g in [(1, 1), (1, 1), (1, 2), (77, 1)]],
        observation_tag=[{"observation_id": o, "tag_id": t} for o, t in [(1, 5), (1, 6), (2, 5), (3, 3)]],
        media_file=[{"media_file_id": 1, "observation_id": 2}],
    )


def test_rows_are_distinct_and_leading_zeros_vanish(tables):
    assert sorted(values(index.index_all(tables), *index.INDEX_KEYS)) == [
        (1, 1, 301), (1, 3, 7), (1, 101, 1), (2, 1, 301), (2, 3, 7), (77, 101, 1),
    ]


def test_unparsable_fids_are_reported(tables):
    assert values(index.index_rejects(tables), "area_id", "fid") == [(4, "no number")]


def test_filter_columns(tables):
    rows = {
        (r.observation_id, r.entity_type_id): (r.taxon_group_id, r.registration_status_id, r.has_media_files)
        for r in index.index_enriched(tables).collect()
    }
    assert rows[(1, 1)] == rows[(1, 101)] == (1, 3, False)
    assert rows[(2, 3)] == (1, 2, True)
    # No observation to copy from: the row keeps the marker.
    assert rows[(77, 101)] == (0, 0, False)


def test_backfill_fills_marked_rows_only_and_repeats(tables):
    marked = index.as_unfilled(index.index_all(tables))
    half = marked.where("observation_id <> 1").unionByName(
        marked.where("observation_id = 1").withColumn("taxon_group_id", F.lit(42))
    )
    once = index.backfill(half, tables)
    kept = once.where("observation_id = 1").select("taxon_group_id").distinct()
    assert values(kept, "taxon_group_id") == [42]
    twice = index.backfill(once, tables)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(once.columns).collect()))
    full = index.backfill(marked, tables)
    whole = index.index_enriched(tables).select(full.columns)
    assert sorted(map(str, full.collect())) == sorted(map(str, whole.collect()))


def test_two_tags_status_differs_between_index_and_tag_filter(tables):
    from sightlines.operators.filters import by_status

    assert sorted(values(by_status(tables.observation, tables, 2), "observation_id")) == [1, 2]
    stored = index.index_enriched(tables).where("registration_status_id = 2").select("observation_id").distinct()
    assert values(stored, "observation_id") == [2]


def test_stored_index_equals_derived_one(stored, supplied):
    derived = index.index_enriched(supplied)
    read = stored.enriched_index.select(derived.columns)
    assert sorted(map(str, read.collect())) == sorted(map(str, derived.collect()))


def test_stored_index_prunes_partitions(stored):
    plan = plan_of(stored.entity_index.where("entity_type_id = 2 AND entity_id = 3").select("observation_id"))
    assert "PartitionFilters: [isnotnull(entity_type_id" in plan
    assert "EqualTo(entity_id,3)" in plan
    counts = dynamic_counts(stored, load_areas(stored, 1), ObservationFilter(taxon_group_ids=(3,), period_from=1998))
    plan = plan_of(counts)
    assert "In(taxon_group_id, [3])" in plan or "EqualTo(taxon_group_id,3)" in plan
    assert "date_time_collected" in plan.split("PushedFilters: [")[1]


def test_soft_delete_zoom_and_dna_rows(make):
    rows = make.frame("behavior_id int, is_deleted boolean, legacy_deleted boolean", [
        {"behavior_id": 1, "is_deleted": False, "legacy_deleted": True},
        {"behavior_id": 2, "is_deleted": False, "legacy_deleted": False},
        {"behavior_id": 3, "is_deleted": True, "legacy_deleted": None},
    ])
    carried = index.carry_soft_delete(rows)
    assert sorted(values(carried, *carried.columns)) == [(1, True), (2, False), (3, True)]
    areas = make.table("area", [area(k, str(k), "n", k, 9) for k in (1, 2, 3)])
    assert sorted(values(index.with_zoom_levels(areas), "area_type_id", "zoom_level")) == [(1, 2), (2, 1), (3, 9)]
    basis = make.table("basis_of_record", [{"basis_of_record_id": 1, "name": "x"}])
    assert sorted(values(index.with_dna_basis(basis), "basis_of_record_id", "name")) == [
        (1, "x"), (16, "dna"), (17, "edna"), (18, "edna_barcoding"),
    ]


def test_hot_location_is_split(spark, make):
    """A location with most observations: the adaptive join splits it, and the result is whole."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = 400_000
        observations = spark.range(0, n, 1, 8).selectExpr(
            "id AS observation_id", "IF(id % 3 = 0, 1, id % 500) AS location_id"
        )
        small = make.tables(
            location=[location(k) for k in range(500)],
            area=[area(1, "3", "c", 2, 1)],
            location_area=[{"location_id": k, "area_id": 1} for k in range(500)],
        ).with_table("observation", observations)
        rows = index.index_areas(small)
        assert rows.count() == n
        assert "skew=true" in _final_plan(rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
