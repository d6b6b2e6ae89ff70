"""Co-located tables give the same lists, and their join has no shuffle."""

from __future__ import annotations

import pytest

from sightlines.operators import layouts, observations
from sightlines.operators.filters import ObservationFilter
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def laid_out(spark, stored, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "tables")
    yield stored.with_layout(layouts.write_layout(stored, "laid_out", path, buckets=4))
    for part in ("observation", "covering"):
        spark.sql(f"DROP TABLE laid_out_{part}")


@pytest.mark.parametrize("fields", [{}, {"category_ids": [9]}, {"county_ids": ["1"], "page_number": 2, "results_per_page": 5}])
def test_lists_are_the_same(stored, laid_out, fields):
    f = ObservationFilter(**fields)
    assert observations.requested_observations(laid_out, f).collect() == observations.requested_observations(stored, f).collect()
    whole = f.but(page_number=None, results_per_page=None)
    assert observations.observations(laid_out, whole).collect() == observations.observations(stored, whole).collect()


def test_no_exchange_below_the_join(spark, laid_out):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = laid_out.observation.select("observation_id", "taxon_id").join(laid_out.covering, "observation_id", "left")
        plan = plan_of(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
