"""Session and small fixtures shared by the tests."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sightlines import schema  # noqa: E402
from sightlines.sources import OccurrenceTables, supplied_tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("sightlines-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def supplied(spark) -> OccurrenceTables:
    return supplied_tables(spark, SMALL)


@pytest.fixture(scope="session")
def stored(spark, supplied, tmp_path_factory) -> OccurrenceTables:
    """The mapped tables and their entity index, written as Parquet and read back."""
    from sightlines.operators.index import index_enriched, write_entity_index

    root = tmp_path_factory.mktemp("occurrence")
    for name in ("observation", "location", "location_area", "area", "taxon", "taxon_name", "taxon_popular_name",
                 "organization", "organization_relation", "observation_tag", "observation_behavior", "media_file",
                 "observation_detail", "export_job"):
        getattr(supplied, name).write.parquet(str(root / name))
    tables = OccurrenceTables.from_parquet(spark, str(root))
    write_entity_index(index_enriched(tables), str(root / "entity_index"))
    return tables.with_stored_index(str(root / "entity_index"))


class Maker:
    """Builds tiny tables; columns that are not named are null."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def table(self, name: str, rows: list[dict]) -> DataFrame:
        return self.frame(schema.OCCURRENCE[name], rows)

    def frame(self, ddl: str, rows: list[dict]) -> DataFrame:
        names = [part.split()[0] for part in ddl.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)

    def tables(self, **rows: list[dict]) -> OccurrenceTables:
        made = {n: rows.get(n, []) for n in schema.OCCURRENCE if n != "entity_index"}
        return OccurrenceTables.from_frames(self.spark, **{n: self.table(n, r) for n, r in made.items()})


@pytest.fixture(scope="session")
def make(spark) -> Maker:
    return Maker(spark)


def observation(key: int, location: int | None = 1, **columns) -> dict:
    defaults = {
        "observation_id": key, "location_id": location, "taxon_group_id": 1, "category_id": 1,
        "basis_of_record_id": 1, "institution_code": "NHM", "coordinate_precision_m": 25, "taxon_id": 1,
        "matched_scientific_name_id": 1, "has_errors": False,
    }
    return {**defaults, **columns}


def location(key: int, **columns) -> dict:
    defaults = {
        "location_id": key, "latitude": 59.91 + key, "longitude": 10.75 + key, "east": 1000 + key,
        "north": 2000 + key, "locality": f"place {key}",
    }
    return {**defaults, **columns}


def area(key: int, fid: str, name: str, kind: int, zoom: int, **columns) -> dict:
    defaults = {
        "area_id": key, "fid": fid, "name": name, "area_type_id": kind, "zoom_level": zoom, "is_current": True,
        "is_deleted": False,
    }
    return {**defaults, **columns}


def values(df: DataFrame, *columns: str) -> list:
    """Collected values: a list of scalars for one column, of tuples for several."""
    rows = df.select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
