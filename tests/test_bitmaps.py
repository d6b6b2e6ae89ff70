"""Facet bitmaps against the filters they stand for."""

from __future__ import annotations

import datetime
import random
import re

import pytest

from sightlines.operators import areas, observations
from sightlines.operators import bitmaps as B
from sightlines.operators.filters import ObservationFilter, apply_filters
from sightlines.operators.index import index_institutions, observation_attributes
from sightlines.sources import shared, supplied
from tests.conftest import area, location, observation, plan_of, values

IDS = [-40_000, -1, 0, 1, 2, 32_768, 32_769, 32_770, 65_536, 65_537, 10**12, 10**12 + 7, *range(100, 130)]


@pytest.fixture(scope="module")
def tables(make):
    r = random.Random(8)
    moments = [None, datetime.datetime(1999, 12, 31, 23, 59, 59), datetime.datetime(1999, 12, 31, 23, 59, 59, 500_000),
               datetime.datetime(2000, 1, 1), datetime.datetime(2001, 6, 5, 4)]
    rows = [
        observation(i, r.choice([1, 2, 3, None]), taxon_group_id=r.choice([1, 2, 3]), category_id=r.choice([9, 11, None]),
                    basis_of_record_id=r.choice([1, 2]), date_time_collected=r.choice(moments))
        for i in IDS
    ]
    of = lambda **columns: [{"observation_id": i, **{k: r.choice(v) for k, v in columns.items()}} for i in IDS + IDS]
    return make.tables(
        observation=rows,
        location=[location(k) for k in (1, 2, 3)],
        location_area=[{"location_id": a, "area_id": b} for a, b in [(1, 10), (1, 20), (1, 60), (2, 11), (2, 20), (3, 40)]],
        area=[area(10, "201", "Asker", 1, 2), area(11, "202", "Moss", 1, 2), area(20, "2", "Viken", 2, 1),
              area(40, "94", "Sea", 4, 1), area(60, "21_99", "Islands", 6, 1)],
        organization=[{"organization_id": k, "name": str(k), "organization_type_id": 1, "is_deleted": False} for k in (5, 6)],
        organization_relation=of(organization_id=[5, 6, 7]),
        observation_tag=of(tag_id=[3, 5, 6])[: len(IDS)],
        observation_behavior=of(behavior_id=[2, 3, 4]),
        media_file=[{"media_file_id": i, "observation_id": i} for i in IDS[::3]] + [{"media_file_id": 9, "observation_id": None}],
    )


@pytest.fixture(scope="module")
def mapped(tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bitmaps") / "all")
    B.write_bitmaps(B.facet_bitmaps(tables), path, files=4)
    return tables.with_bitmaps(path)


REQUESTS = [
    {"taxon_group_ids": [1, 3]}, {"category_ids": [9]}, {"basis_of_record_ids": [2], "months": [12]},
    {"period_to": 1999}, {"period_from": 2000}, {"period_from": 1999, "period_to": 1999}, {"months": [1, 6]},
    {"registration_status_id": 1}, {"registration_status_id": 2}, {"registration_status_id": 3}, {"with_images": True},
    {"with_images": False}, {"county_ids": ["2", "21_99"]}, {"municipality_ids": ["201"], "ocean_area_ids": ["94"]},
    {"municipality_ids": ["x"]}, {"organization_ids": [5]}, {"behavior_ids": [2, 4], "county_ids": ["2"]},
    {"organization_ids": [6], "county_ids": ["2"], "with_images": False, "taxon_group_ids": [1, 2]},
]


@pytest.mark.parametrize("fields", REQUESTS)
def test_bitmaps_equal_filters(tables, mapped, fields):
    f = ObservationFilter(**fields)
    scanned = sorted(values(apply_filters(tables.observation, tables, f), "observation_id"))
    assert sorted(values(mapped.bitmaps.ids(f), "observation_id")) == scanned
    assert values(mapped.bitmaps.count(f), "n") == [len(scanned)]
    assert sorted(values(B.apply_bitmaps(mapped.observation, mapped, f), "observation_id")) == scanned
    exported = sorted(values(apply_filters(tables.observation, tables, f, mode="export"), "observation_id"))
    assert sorted(values(B.apply_bitmaps(mapped.observation, mapped, f, mode="export"), "observation_id")) == exported


@pytest.mark.parametrize("fields", [x for x in REQUESTS if ObservationFilter(**x).needs_dynamic_counts()])
def test_counts_equal_those_of_the_index(tables, mapped, fields):
    f = ObservationFilter(**fields)
    for zoom in (1, 2):
        found, expected = (sorted(map(tuple, areas.area_counts(t, zoom, f).collect())) for t in (mapped, tables))
        assert found == expected


def test_other_filters_stay(tables, mapped):
    f = ObservationFilter(taxon_group_ids=[1, 2], precision_to=25, collection_code="x")
    assert not mapped.bitmaps.answers(f) and mapped.bitmaps.answers(f.but(precision_to=None, collection_code=None))
    assert B.rest_of(f) == ObservationFilter(precision_to=25, collection_code="x")
    assert values(mapped.bitmaps.count(ObservationFilter()), "n") == [len(IDS)]


def test_new_observations_are_merged(tables):
    whole = B.facet_bitmaps(tables)
    halves = [B.facet_bitmaps(tables.with_table("observation", tables.observation.where(f"observation_id % 2 {op} 0")))
              for op in ("=", "<>")]
    key = lambda r: (r.facet, r.value, r.bucket, bytes(r.bitmap))
    assert sorted(map(key, B.merged_bitmaps(*halves).collect())) == sorted(map(key, whole.collect()))


def test_ids_move_and_bitmaps_stay(tables, tmp_path):
    """Partial bitmaps of 4 KB are not shuffled, nor are whole ones moved or sorted to be stored."""
    plan = plan_of(B.facet_bitmaps(tables, files=3).sortWithinPartitions("facet", "value", "bucket"))
    nodes = re.findall(r"(\w+) \(\d+\)", plan.split("\n\n")[0])
    above = nodes[: nodes.index("Exchange")]
    assert above.count("SortAggregate") == 2 and above.count("Sort") == 1
    for name, dealt in (("moved", False), ("dealt", True)):
        B.write_bitmaps(B.facet_bitmaps(tables, files=3), str(tmp_path / name), files=3, dealt=dealt)
    moved, dealt = (
        sorted(map(tuple, tables.with_bitmaps(str(tmp_path / name)).bitmaps.rows.collect()), key=repr) for name in ("moved", "dealt")
    )
    assert moved == dealt and moved


def test_tables_are_stored_one_by_one(tables, tmp_path):
    """What is stored table by table is what the union of all facets gives, with no facet in two parts."""
    path = str(tmp_path / "parts")
    B.write_facet_bitmaps(tables, path, files=3)
    rows = lambda frame: sorted(map(tuple, frame.select("facet", "value", "bucket", "n", "bitmap").collect()), key=repr)
    assert rows(tables.with_bitmaps(path).bitmaps.rows) == rows(B.facet_bitmaps(tables))
    facets = [{r.facet for r in part.select("facet").distinct().collect()} for part in B._facet_parts(tables)]
    assert len(facets) == 5 and sum(map(len, facets)) == len(set().union(*facets))


def test_lines_are_dealt_into_a_given_number(spark):
    """Ids compress well: put together by their compressed size, they were too many for one task's memory."""
    lines = spark.sql(
        "SELECT id div 3 AS l_orderkey, CAST(id % 2 AS INT) AS l_linenumber, id % 5 AS l_suppkey, 5 AS l_quantity, substring('ARN', CAST(id % 3 AS INT) + 1, 1) AS l_returnflag "
        "FROM range(300)"
    )
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for build in (supplied._observation_behavior, supplied._observation_tag, supplied._organization_relation):
        frame = build(lambda name: lines)
        assert frame.rdd.getNumPartitions() == number
        assert sorted(frame.collect()) == sorted({tuple(r) for r in frame.collect()})
    hot = lines.selectExpr("l_orderkey - l_orderkey AS l_orderkey", "l_orderkey AS l_suppkey")
    parts = supplied._organization_relation(lambda name: hot).rdd.glom().map(len).collect()
    assert sum(parts) == 100 and max(parts) < 100


def test_more_rows_are_more_tasks(spark, tables, tmp_path, monkeypatch):
    """With the session's number of partitions alone, a task's memory grew with the rows."""
    lines = spark.sql(
        "SELECT id div 3 AS l_orderkey, id % 7 AS l_partkey, CAST(id % 2 AS INT) AS l_linenumber, id % 5 AS l_suppkey, 5 AS l_quantity, "
        "substring('ARN', CAST(id % 3 AS INT) + 1, 1) AS l_returnflag FROM range(300)"
    )
    orders = spark.sql(
        "SELECT id AS o_orderkey, id % 4 AS o_custkey, 'F' AS o_orderstatus, 5.0D AS o_totalprice, "
        "TIMESTAMP_NTZ '2000-01-01 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(200)"
    )
    parts = spark.sql("SELECT id AS p_partkey, 'Brand#11' AS p_brand FROM range(7)")
    raw = {"lineitem": lines, "orders": orders, "part": parts}.get
    builds = (supplied._observation_behavior, supplied._observation_tag, supplied._organization_relation, supplied._observation)
    before = [sorted(build(raw).collect(), key=repr) for build in builds]
    monkeypatch.setattr(shared, "ROWS_TOGETHER", 20)
    frames = [build(raw) for build in builds]
    assert [frame.rdd.getNumPartitions() for frame in frames] == [15, 15, 15, 10]
    assert [sorted(frame.collect(), key=repr) for frame in frames] == before
    assert observation_attributes(tables, 9).rdd.getNumPartitions() == 9
    related = tables.with_table("organization_relation", tables.organization_relation.repartition(9, "observation_id", "organization_id").distinct())
    assert index_institutions(related).rdd.getNumPartitions() == 9
    ranges, built = [], B._built
    monkeypatch.setattr(B, "_built", lambda rows, files: ranges.append((rows.count(), files)) or built(rows, files))
    path = str(tmp_path / "parts")
    B.write_facet_bitmaps(tables, path)
    assert len(ranges) == 5 and all(files == max(4, -(-rows // 20)) for rows, files in ranges) and ranges[0][1] > 4
    rows = lambda frame: sorted(map(tuple, frame.select("facet", "value", "bucket", "n", "bitmap").collect()), key=repr)
    assert rows(tables.with_bitmaps(path).bitmaps.rows) == rows(B.facet_bitmaps(tables))


def test_no_id_is_shuffled(mapped):
    f = ObservationFilter(county_ids=["2"], ocean_area_ids=["94"], category_ids=[9], organization_ids=[5])
    for frame in (mapped.bitmaps.count(f), areas.area_counts(mapped, 1, f), B.apply_bitmaps(mapped.observation, mapped, f)):
        plan = plan_of(frame)
        shuffled = re.findall(r"hashpartitioning\(([^)]*)", plan)
        assert shuffled and not any("observation_id" in keys for keys in shuffled)
    assert "PartitionFilters" in plan_of(mapped.bitmaps.count(f)) and "value" in plan_of(mapped.bitmaps.count(f))


@pytest.mark.parametrize("fields", [{}, {"county_ids": ["2"]}, {"county_ids": ["2"], "category_ids": [9, 11]}, {"behavior_ids": [9]}])
@pytest.mark.parametrize("together", [1, 2, 1_024])
def test_windows(tables, mapped, monkeypatch, fields, together):
    monkeypatch.setattr(B, "BUCKETS_TOGETHER", together)
    f = ObservationFilter(**fields)
    every = sorted(values(apply_filters(tables.observation, tables, f), "observation_id"))
    for skip, take in ((0, 3), (2, 5), (5, 1), (9, 40), (len(every), 2), (10**9, 7), (1, 0)):
        assert values(mapped.bitmaps.window(f, skip, take), "observation_id") == every[skip : skip + take]


def test_one_value_is_located_without_bitmaps(mapped):
    plan = plan_of(mapped.bitmaps.bucket_counts(ObservationFilter(municipality_ids=["201"])))
    assert "bitmap" not in plan.replace("bitmaps", "") and "PartitionFilters" in plan


def test_pages_through_bitmaps(tables, mapped):
    for number in (1, 3, 8):
        f = ObservationFilter(category_ids=[9, 11], page_number=number, results_per_page=3)
        assert observations.page_ids(mapped, f).collect() == observations.page_ids(tables, f).collect()
        assert observations.requested_observations(mapped, f).collect() == observations.requested_observations(tables, f).collect()
