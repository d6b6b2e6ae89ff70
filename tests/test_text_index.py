"""The trigram index against the scan, on odd texts and small chunks."""

from __future__ import annotations

import glob
import random

import pyarrow.parquet as pq
import pytest

from sightlines.operators import taxa
from sightlines.operators import text_index as X
from sightlines.operators.filters import ObservationFilter, apply_filters
from sightlines.functions.scalars import contains_text
from tests.conftest import plan_of, values

TEXTS = ["", "a", "ab", "abc", "ABC_d", "50%", "x\x00y", "ÉÜß", "😀😀b", "it's \\n", " lead", None, "abab" * 500]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    made = list(enumerate(TEXTS, 32_760)) + [(-5, "abc minus"), (10**12, "far abc"), (None, "abc")]
    made += [(100_000 + i, "".join(r.choice("abcd_ ") for _ in range(r.randrange(12)))) for i in range(400)]
    return spark.createDataFrame(made, "id bigint, text string")


def as_rows(rows):
    return rows.where("id IS NOT NULL AND text IS NOT NULL").selectExpr("'organization.name' AS field", "id", "text")


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    """Written in two steps: some chunks stand beside those of the first."""
    path = str(tmp_path_factory.mktemp("text") / "index")
    X.write_text_index(as_rows(rows.where("id % 2 = 0")), path, files=3)
    X.write_text_index(as_rows(rows.where("id % 2 <> 0")), path, mode="append", files=3)
    return X.TextIndex(spark, path)


TERMS = ["a", "b_", "abc", "ABC", "c_d", "cd ab", "50%", "%", "_", "x\x00y", "éü", "ß", "😀b", "'s \\", "abababab", "zzz", "minus", " "]


@pytest.mark.parametrize("term", TERMS)
def test_search_equals_scan(rows, index, term):
    scanned = rows.where("id IS NOT NULL").where(contains_text("text", term))
    found = index.ids("organization", "name", term)
    assert sorted(values(found, "organization_id")) == sorted(values(scanned, "id"))


def test_empty_term_finds_every_text(rows, index):
    every = rows.where("id IS NOT NULL AND text IS NOT NULL")
    assert sorted(values(index.ids("organization", "name", ""), "organization_id")) == sorted(values(every, "id"))


def test_rarest_first(index):
    sizes = dict(map(tuple, index._part("pieces", "organization.name").select("piece", "size").collect()))
    pieces = index.rarest("organization.name", "far abc")
    assert [sizes[p] for p in pieces] == sorted(sizes[p] for p in X.pieces_of("far abc"))[: X.INTERSECTED]
    assert index.rarest("organization.name", "qqq") is None


def test_plan_reads_posting_partitions(index):
    plan = plan_of(index.candidates("organization.name", "abc_d"))
    assert "PartitionFilters: [isnotnull(field" in plan and "In(piece" in plan and "texts" not in plan


def test_offsets_are_stored_as_deltas(index):
    path = glob.glob(f"{index.path}/postings/field=*/*.parquet")[0]
    group = pq.ParquetFile(path).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["offsets.list.element"].encodings


def test_chunks_are_bounded(spark):
    rows = spark.range(100_000).selectExpr("'f' AS field", "id", "'same' AS text")
    found = X.postings(rows)
    assert {r.piece for r in found.select("piece").collect()} == {"sam", "ame", "me\x00", "e\x00\x00"}
    assert found.selectExpr("max(size)").scalar is not None and max(values(found, "size")) == 1 << X.CHUNK_BITS


def test_nothing_to_index(spark, tmp_path):
    path = str(tmp_path / "index")
    X.write_text_index(spark.createDataFrame([], "field string, id bigint, text string"), path)
    assert X.TextIndex(spark, path).ids("organization", "name", "abc").count() == 0


def test_every_filter_goes_through_the_index(make, tmp_path):
    tables = make.tables(
        observation=[
            {"observation_id": i, "collection_code": c, "catalog_number": n, "taxon_id": i % 3, "matched_scientific_name_id": i % 4}
            for i, (c, n) in enumerate([("Birds", "C_1"), ("birds2", None), (None, "C-1"), ("Fish", "xc_12")] * 3)
        ],
        organization=[{"organization_id": 1, "name": "Old Museum", "is_deleted": False}],
        organization_relation=[{"observation_id": 4, "organization_id": 1}],
        taxon=[{"taxon_id": i, "preferred_popular_name": n, "is_deleted": False, "exists_in_country": True}
               for i, n in enumerate(["Red fox", "fox", None])],
        taxon_name=[{"taxon_name_id": i, "taxon_id": i % 3, "scientific_name": n, "scientific_name_authorship": "L.", "is_deleted": False}
                    for i, n in enumerate(["Vulpes", "Vulpes alba", "Canis", None])],
        taxon_popular_name=[{"taxon_popular_name_id": 9, "taxon_id": 2, "name": "dog vulp", "is_deleted": False}],
    )
    X.write_text_index(X.text_rows(tables), str(tmp_path / "index"))
    indexed = tables.with_text_index(str(tmp_path / "index"))
    for fields in (
        {"collection_code": "BIRD"}, {"catalog_number": "c_1"}, {"catalog_number": "1"}, {"project_name": "museum"},
        {"preferred_popular_name": "fox"}, {"scientific_name": "vulpes", "author": "l."}, {"author": "."},
        {"collection_code": "b", "catalog_number": "1", "scientific_name": "s"}, {"collection_code": "none"},
    ):
        f = ObservationFilter(**fields)
        scan, search = (sorted(values(apply_filters(t.observation, t, f), "observation_id")) for t in (tables, indexed))
        assert search == scan
        assert scan or "none" in fields.values()
    for term in ("vulp", "VULPES ALBA", "a", "  "):
        assert taxa.taxon_search(indexed, term).collect() == taxa.taxon_search(tables, term).collect()
    assert indexed.with_table("taxon", tables.taxon).text_index is indexed.text_index


def test_texts_are_dealt_out_before_they_are_cut(spark):
    rows = spark.createDataFrame([("f", 1, "abc")], "field string, id bigint, text string").coalesce(1)
    tree = plan_of(X.postings(rows)).split("\n\n")[0]
    assert "Exchange" in tree[tree.index("Generate") :]
