"""Export columns, rows, summary, jobs and CSV files."""

from __future__ import annotations

import csv
import glob
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sightlines.functions.scalars import abbreviated, export_slug, number_text, zoom_bucket
from sightlines.operators import export, locations
from sightlines.operators.filters import ObservationFilter
from sightlines.sources import sinks
from sightlines.sources.sinks import write_csv, write_csv_document, write_lines
from tests.conftest import observation, plan_of, values


@pytest.fixture(scope="module")
def tables(make):
    return make.tables(
        observation=[
            observation(2, latitude=59.0, longitude=10.125, has_errors=True, catalog_number='a;"b"',
                        date_time_collected=datetime(2020, 5, 6, 7, 8, 9)),
            observation(1, latitude=None, collection_code="line\nbreak", catalog_number=" padded "),
            observation(10, catalog_number="", taxon_group_id=2),
        ],
        observation_detail=[{"observation_id": 2, "notes": "n", "dataset_name": "d", "minimum_elevation_m": 5}],
        export_job=[
            {"job_id": 1, "user_id": "u", "name": "My export!",
             "filter_json": '{"TaxonGroupIds":[1],"Period":{"From":2020,"To":null,"Months":null},"Unknown":1}',
             "selected_columns": '["Id","Detail.Notes"]'},
            {"job_id": 2, "user_id": "u", "name": None, "filter_json": "null", "selected_columns": "[]"},
        ],
    )


def test_registry():
    assert len(export.COLUMNS) == 49
    assert sum(not c.is_detail for c in export.COLUMNS) == 26
    assert len(export.default_columns()) == 13
    assert [c.name for c in export.resolve_columns(["detail.notes", "nope", "ID"])] == ["Detail.Notes", "Id"]
    assert export.resolve_columns(["nope"]) == export.default_columns() == export.resolve_columns([])


def test_headers_and_missing_columns(tables):
    rows = export.export_rows(tables, ObservationFilter())
    assert rows.columns == [c.header for c in export.default_columns()]
    every = export.export_rows(tables, ObservationFilter(), [c.name for c in export.COLUMNS])
    assert len(every.columns) == 49 and every.count() == 3
    row = every.where("Id = 2").first()
    assert row["Innsamlingsår"] == 2020 and row["Innsamlingsmåned"] == 5 and row["Min høyde (meter)"] == 5


def test_detail_joins_only_when_asked(tables):
    plain = export.export_rows(tables, ObservationFilter(), ["Id", "TaxonId"])
    assert "Join" not in plan_of(plain)
    assert "LeftOuter" in plan_of(export.export_rows(tables, ObservationFilter(), ["Id", "Detail.Notes"]))


def test_single_document_bytes(tables, tmp_path):
    names = ["Id", "CatalogNumber", "CollectionCode", "DateTimeCollected", "Latitude", "Longitude", "HasErrors"]
    path = str(tmp_path / "one")
    write_csv_document(export.export_rows(tables, ObservationFilter(), names), path)
    (part,) = glob.glob(os.path.join(path, "part-*"))
    text = open(part, "rb").read().decode("utf-8")
    assert text == (
        "﻿sep=;\n"
        "Id;Katalognummer;Samlingskode;Innsamlingsdato;Breddegrad;Lengdegrad;Har feil\n"
        '1; padded ;"line\nbreak";;;;0\n'
        '2;"a;""b""";;2020-05-06 07:08:09;59;10.125;1\n'
        "10;;;;;;0\n"
    )
    with pytest.raises(ValueError):
        write_csv_document(export.export_rows(tables, ObservationFilter(), names), path + "2", limit=2)


def test_distributed_csv_reads_back(tables, supplied, tmp_path):
    path = str(tmp_path / "many")
    rows = export.export_rows(supplied, ObservationFilter(), ["Id", "CatalogNumber", "Detail.Notes", "Latitude"])
    write_csv(rows, path)
    got = []
    for part in sorted(glob.glob(os.path.join(path, "part-*.csv"))):
        with open(part, encoding="utf-8", newline="") as f:
            lines = list(csv.reader(f, delimiter=";"))
        assert lines[0] == ["Id", "Katalognummer", "Merknader", "Breddegrad"]
        got += lines[1:]
    expected = [[x or "" for x in r] for r in export.as_text(rows.orderBy("Id")).collect()]
    assert got == expected  # part files follow each other in id order
    small = str(tmp_path / "small")
    write_csv(export.export_rows(tables, ObservationFilter(), ["Id", "CatalogNumber"]), small)
    body = "".join(open(p).read() for p in sorted(glob.glob(os.path.join(small, "part-*.csv"))))
    assert '2;"a;""b"""\n' in body and "1; padded \n" in body and "10;\n" in body


def test_lines_sink(spark, tmp_path):
    write_lines(spark.range(3).selectExpr("concat('[', id, ']') AS line"), str(tmp_path / "l"))
    assert sorted(values(spark.read.text(str(tmp_path / "l")), "value")) == ["[0]", "[1]", "[2]"]


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_one_file_by_many_tasks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(sinks, "BLOCK_BYTES", block)
    path = str(tmp_path / "d")
    lines = spark.range(60, -1, -1, 4).selectExpr("id AS key", "nullif(repeat('æ', int(id % 5)), '') AS value")
    sinks.write_document(lines, path, ["key"], "head\n", "foot")
    (part,) = glob.glob(os.path.join(path, "part-*"))
    expected = "head\n" + "".join("æ" * (i % 5) + "\n" for i in range(61)) + "foot"
    assert open(part, encoding="utf-8").read() == expected
    assert os.listdir(tmp_path) == ["d"]  # nothing is left beside it
    with pytest.raises(FileExistsError):
        sinks.write_document(lines, path, ["key"])
    sinks.write_document(lines.limit(0), path, ["key"], "a", "b", mode="overwrite")
    assert "".join(values(spark.read.text(path), "value")) == "ab"


def test_location_document_as_a_file(spark, tables, supplied, tmp_path):
    for name, t in (("few", tables), ("many", supplied)):
        located = locations.locations(t)
        sinks.write_location_document(located, str(tmp_path / name), 4326)
        (part,) = glob.glob(os.path.join(tmp_path / name, "part-*"))
        got = json.load(open(part))
        order = located.orderBy(F.desc("observation_count"), "location_id").collect()
        assert got["epsg"] == 4326
        assert [tuple(x) for x in got["locations"]] == [(r[0], r[2], r[1], r[3]) for r in order]
    sinks.write_location_document(located.limit(0), str(tmp_path / "none"), 4326)
    (part,) = glob.glob(os.path.join(tmp_path / "none", "part-*"))
    assert json.load(open(part)) == {"epsg": 4326, "locations": []}


def test_summary_and_limits(tables):
    row = export.export_summary(tables, ObservationFilter(), ["Id", "TaxonId"], "a b", soft_limit=2, hard_limit=3).first()
    assert tuple(row) == (3, int(3 * (500 * (2 / 49) + 3)), True, False, "a-b")
    assert export.export_summary(tables, ObservationFilter()).first().export_name == "eksport"
    assert export.exceeds_limit(tables.observation, 2) and not export.exceeds_limit(tables.observation, 3)
    assert export.limit_check(tables.observation, 2).first()[0] is True


def test_stored_jobs(tables):
    rows, slug = export.run_job(tables, 1)
    assert slug == "1-My-export" and rows.columns == ["Id", "Merknader"]
    assert values(rows, "Id", "Merknader") == [(2, "n")]
    rows, slug = export.run_job(tables, 2)
    assert slug == "2-eksport" and rows.count() == 3 and len(rows.columns) == 13
    with pytest.raises(ValueError):
        export.run_job(tables, 3)
    columns = export.known_job_columns(tables.export_job)
    assert values(columns.where("job_id = 1").orderBy("position"), "column", "header") == [
        ("Id", "Id"), ("Detail.Notes", "Merknader"),
    ]


def evaluate(spark, expression: str, values_: list, kind: str) -> list:
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(F.expr(expression)).collect()]


def test_slug(spark):
    names = ["Blåmeis i 2024!", None, "   ", "a_b-c d", "!!!", "x/\\y", "\t"]
    expected = ["Blåmeis-i-2024", "eksport", "eksport", "a_b-c-d", "eksport", "xy", "eksport"]
    assert evaluate(spark, export_slug("v"), names, "string") == expected


def test_abbreviation(spark):
    counts = [0, 999, 1000, 1049, 1050, 1450, 1949, 999_949, 999_950, 1_000_000, 1_250_000, 12_345_678]
    expected = ["0", "999", "1K", "1K", "1.1K", "1.5K", "1.9K", "999.9K", "1000K", "1M", "1.3M", "12.3M"]
    assert evaluate(spark, abbreviated("v"), counts, "bigint") == expected


def test_zoom(spark):
    assert evaluate(spark, zoom_bucket("v"), [0.0, 6.2, 8.99, 9.0, 10.9, 11.0, 18.0], "double") == [1, 1, 1, 2, 2, 3, 3]


def test_number_text(spark):
    numbers = [0.0, -0.0, 59.0, 10.75, -1.5, 0.1, 123456789.5, 1e14, 1e15, 1.5e22, 0.00012, 1e-5, 1.25e-7, None]
    expected = ["0", "0", "59", "10.75", "-1.5", "0.1", "123456789.5", "100000000000000", "1E+15", "1.5E+22",
                "0.00012", "0.00001", "1.25E-07", None]
    assert evaluate(spark, number_text("v"), numbers, "double") == expected
