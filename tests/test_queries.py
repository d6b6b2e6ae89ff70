"""Every named query against DuckDB on the smallest supplied tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from sightlines.plans import oracle, queries as named
from tests.conftest import SMALL

QUERIES, ORACLE = named.queries(), oracle.oracle_sql()


def _connect(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def duck():
    return _connect(SMALL)


# A third of the rows share one customer, order, part, supplier, user, nation or brand.
_HOT = {
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)",
    "lineitem": """SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey,
                   CASE WHEN l_linenumber % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey,
                   CASE WHEN l_linenumber % 3 = 1 THEN 4 ELSE l_suppkey END AS l_suppkey)""",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id)",
    "customer": "SELECT * REPLACE (CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE c_nationkey END AS INT) AS c_nationkey)",
    "part": "SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'Brand#3' ELSE p_brand END AS p_brand)",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)[:-8]
        select = _HOT.get(name, "SELECT *")
        connection.execute(f"COPY ({select} FROM '{path}') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder, _connect(folder)


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) else round(value, 9)
    return value


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


_SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    relation = duck.execute(ORACLE[name])
    columns = [c[0] for c in relation.description]
    types = {c[0]: str(c[1]) for c in relation.description}
    want = relation.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert _normal(df.columns, got) == _normal(columns, want)
    assert {n: _SAME_TYPE[t] for n, t in df.dtypes} == types


@pytest.mark.parametrize(
    "name",
    ["index_enriched", "f_combined_search", "f_status_2", "locations", "observations_page", "area_counts_dynamic",
     "sample_observations", "polygons_all", "geojson_locations", "history", "bbox_overlap", "export_rows"],
)
def test_skewed_data_gives_whole_results(spark, skewed, name):
    folder, connection = skewed
    df = QUERIES[name](spark, folder)
    relation = connection.execute(ORACLE[name])
    columns = [c[0] for c in relation.description]
    assert _normal(df.columns, [tuple(r) for r in df.collect()]) == _normal(columns, relation.fetchall())


def test_flagship(spark):
    df = driver.entry(spark)
    assert df.columns == ["location_id", "latitude", "longitude", "observation_count"] and df.count() > 0
