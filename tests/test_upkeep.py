"""Backfill in batches and merging of changes against an index built anew."""

from __future__ import annotations

import glob
import os

import pytest

from sightlines.operators import index as I
from sightlines.operators import upkeep as U
from sightlines.plans import queries
from tests.conftest import area, location, observation, plan_of


def _tables(make, observations, tags=()):
    ids = [o["observation_id"] for o in observations]
    return make.tables(
        observation=observations,
        location=[location(k) for k in (1, 2)],
        location_area=[{"location_id": 1, "area_id": 10}, {"location_id": 2, "area_id": 11}, {"location_id": 2, "area_id": 20}],
        area=[area(10, "201", "Asker", 1, 2), area(11, "202", "Moss", 1, 2), area(20, "2", "Viken", 2, 1)],
        organization=[{"organization_id": 5, "name": "o", "organization_type_id": 1, "is_deleted": False}],
        organization_relation=[{"observation_id": i, "organization_id": 5} for i in ids if i % 2],
        observation_tag=[{"observation_id": i, "tag_id": t} for i, t in tags],
        media_file=[{"media_file_id": 1, "observation_id": i} for i in ids[:1]],
    )


IDS = [-3, 0, 1, 5, 9, 10, 11, 25, 26, 47]


@pytest.fixture(scope="module")
def tables(make):
    return _tables(make, [observation(i, 1 + i % 2) for i in IDS], [(1, 5), (47, 6)])


def rows(frame):
    return sorted(map(repr, frame.select(*U._COLUMNS).collect()))


def test_a_killed_run_is_taken_up(spark, tables, tmp_path):
    marked, path = I.as_unfilled(I.index_all(tables)), str(tmp_path / "index")
    assert U.backfill_batches(marked, tables, path, batch_ids=10, together=2, jobs=1) == 2
    assert U.finished_batches(spark, path) == {-1, 0}
    # a job that ended before its entry in the journal: half its rows, and wrong ones
    U._write(marked.where("observation_id = 25").selectExpr("*", "2L AS batch"), path, spark.createDataFrame([(2,)], "batch bigint"))
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/batch=0/*.parquet")}
    assert U.backfill_batches(marked, tables, path, batch_ids=10, together=2) == 3
    assert rows(U.batched_index(spark, path)) == rows(I.index_enriched(tables))
    assert before == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/batch=0/*.parquet")}
    assert U.backfill_batches(marked, tables, path, batch_ids=10) == 0


def test_each_job_reads_its_range(tables):
    plan = plan_of(I.index_enriched(U.within_ids(tables, 10, 19)))
    assert "observation_id" in plan and ">= 10" in plan and "<= 19" in plan


def test_changes_are_merged(spark, make, tables, tmp_path):
    path = str(tmp_path / "index")
    U.write_batched_index(I.index_enriched(tables), path, batch_ids=10)
    files = lambda batch: sorted(glob.glob(f"{path}/rows/batch={batch}/*.parquet"))
    untouched = files(0)
    # 10 moves, 11 is retagged, 12 and 90 come, 25 and 26 (all of their batch) go, 47 changes its group; late and repeated
    kept = [observation(i, 1 + i % 2) for i in IDS if i not in (10, 25, 26, 47)]
    after = _tables(make, [*kept, observation(10, 2), observation(12, 1), observation(90, 2), observation(47, 2, taxon_group_id=9)],
                    [(1, 5), (11, 6)])
    changed = spark.createDataFrame([(i,) for i in (10, 11, 12, 12, 90, 25, 26, 47, 1000, None)], "observation_id bigint")
    U.merge_changes(changed, after, path, batch_ids=10)
    expected = rows(I.index_enriched(after))
    # the tables give their first observation a media file; that one did not change
    assert rows(U.batched_index(spark, path)) == expected
    assert files(0) == untouched
    U.merge_changes(changed, after, path, batch_ids=10)
    assert rows(U.batched_index(spark, path)) == expected


def _counting(spark, frame):
    """The frame with a counter of its rows' readings."""
    seen = spark.sparkContext.accumulator(0)

    def one(row):
        seen.add(1)
        return tuple(row)

    return spark.createDataFrame(spark.sparkContext.parallelize([tuple(r) for r in frame.collect()], 3).map(one), frame.schema), seen


def test_a_whole_index_is_derived_once(spark, tables, tmp_path):
    full = I.index_enriched(tables)
    counted, seen = _counting(spark, full)
    U.write_batched_index(counted, str(tmp_path / "index"), batch_ids=10)
    assert seen.value == full.count() > 0
    assert rows(U.batched_index(spark, str(tmp_path / "index"))) == rows(full)


def test_changed_ids_are_read_once(spark, tables, tmp_path):
    path = str(tmp_path / "index")
    U.write_batched_index(I.index_enriched(tables), path, batch_ids=10)
    ids = spark.createDataFrame([(i,) for i in (10, 11, 11, 47, None)], "observation_id bigint")
    counted, seen = _counting(spark, ids)
    U.merge_changes(counted, tables, path, batch_ids=10)
    assert seen.value == 5
    assert rows(U.batched_index(spark, path)) == rows(I.index_enriched(tables))


def test_the_resumed_backfill_reads_a_stored_index(supplied, monkeypatch):
    plans, run = [], U.backfill_batches
    monkeypatch.setattr(U, "backfill_batches", lambda index, *a, **b: (plans.append(plan_of(index)), run(index, *a, **b))[1])
    assert rows(queries.backfill_resumed(supplied)) == rows(I.index_enriched(supplied))
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)
