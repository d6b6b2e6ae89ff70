"""Species records, logs, streaming, samples and tables."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sightlines.operators import logs, sampling, species
from sightlines.sources import OccurrenceTables
from sightlines.streaming import start_slow_log
from tests.conftest import plan_of, values


def test_species_shapes(make):
    search = {
        "taxonId": 7, "acceptedScientificName": {"name": "A b", "nameFormatted": "<i>A b</i>", "author": "L.", "rank": "species"},
        "preferredVernacularNames": [{"name": "x", "nameLanguageIso": "nb"}], "vernacularNameSynonyms": [],
        "scientificNameSynonyms": [{"name": "A c", "nameFormatted": "f", "author": "M.", "rank": "species", "extra": 1}],
    }
    names = [{"taxonomicStatus": "Synonym", "scientificNamePresentation": "old"},
             {"taxonomicStatus": "Accepted", "scientificNamePresentation": "new", "taxonRank": "genus"},
             {"taxonomicStatus": "Accepted", "scientificNamePresentation": "second"},
             {"taxonomicStatus": "Other", "scientificNamePresentation": "none"}]
    vernaculars = [{"vernacularName": "v1", "vernacularNameStatus": "Recommended", "languageIsoCode": "nb"},
                   {"vernacularName": "v2", "vernacularNameStatus": "Allowed", "languageIsoCode": "nn"}, {"vernacularName": "v3"}]
    bodies = [("search", search), ("by_id", {"taxonId": 8, "scientificNames": names, "vernacularNames": vernaculars}),
              ("by_id", {"taxonId": 9, "scientificNames": names[:1], "vernacularNames": vernaculars}),
              ("by_id", {"taxonId": 10})]
    df = make.table("species_response", [{"response_id": i, "shape": s, "body": json.dumps(b)} for i, (s, b) in enumerate(bodies)])
    a, b, c, d = species.species_records(df).orderBy("response_id").collect()
    assert (a.taxon_id, a.scientific_name, a.author, a.rank) == (7, "A b", "L.", "species")
    assert [v.name for v in a.preferred_vernacular_names] == ["x"] and a.vernacular_name_synonyms == []
    assert [s.name for s in a.scientific_name_synonyms] == ["A c"]
    assert (b.scientific_name, b.rank) == ("new", "genus")
    assert [v.name for v in b.preferred_vernacular_names] == ["v1"]
    assert [v.name for v in b.vernacular_name_synonyms] == ["v2", "v3"]
    assert [s.name for s in b.scientific_name_synonyms] == ["old"]
    for bare in (c, d):
        assert bare.scientific_name is None and bare.author is None
        assert bare.preferred_vernacular_names == bare.scientific_name_synonyms == []


def test_fingerprint_depends_on_content_not_order(make):
    ddl = "fid string, observation_count bigint"
    rows = [{"fid": "2", "observation_count": 5}, {"fid": "1", "observation_count": 3}]
    one, two = (logs.fingerprint(make.frame(ddl, r)).first()[0] for r in (rows, rows[::-1]))
    other = logs.fingerprint(make.frame(ddl, rows[:1])).first()[0]
    assert one == two != other and one.startswith('"') and len(one) == 34


def test_history_and_retention(make):
    now = datetime(2024, 5, 10, 12)
    day = timedelta(days=1)
    rows = [
        (1, "Complete", "p", None, now - 9 * day, now - day), (2, "Complete", "p", None, now, now + day),
        (3, "Complete", "p", None, now, None), (4, "Failed", "p", None, now - 2 * day, None),
        (5, "Failed", None, None, now - 2 * day, None), (6, "Cancelled", None, "x", now - 2 * day, None),
        (7, "Cancelled", "p", None, now, None), (8, "Pending", "p", None, now - 9 * day, now - day),
    ]
    jobs = make.table("export_job", [
        {"job_id": k, "user_id": "u" if k < 8 else "w", "status": s, "blob_path": b, "excel_blob_path": e,
         "completed_at": c, "expires_at": x, "created_at": now + k * day, "file_size": 5} for k, s, b, e, c, x in rows
    ])
    gone = logs.expired_jobs(jobs, F.lit("2024-05-10 12:00:00").cast("timestamp_ntz"))
    assert sorted(values(gone, "job_id")) == [1, 4, 6]
    assert values(logs.without_files(gone).distinct(), "blob_path", "excel_blob_path", "file_size")[0] == (None, None, 0)
    assert values(logs.history(jobs, "u", 3), "job_id") == [7, 6, 5]
    assert sorted(values(logs.newest_per_user(jobs, 2), "job_id")) == [6, 7, 8]


def test_slow_log_batch_and_stream(spark, make, tmp_path):
    body = "é" * 5000
    rows = [{"request_id": k, "endpoint": "e", "elapsed_ms": ms, "request_body": b, "occurred_at": datetime(2024, 1, 1)}
            for k, ms, b in [(1, 999, "a"), (2, 1000, body), (3, 4000, None)]]
    requests = make.table("request_log", rows)
    batch = logs.slow_requests(requests)
    assert sorted(values(batch, "request_id", F.length("request_body"))) == [(2, 4000), (3, None)]
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    requests.write.parquet(source)
    start_slow_log(spark, source, sink, mark).awaitTermination(120)
    requests.where("request_id = 3").selectExpr("4L AS request_id", "endpoint", "elapsed_ms", "request_body", "occurred_at").write.mode(
        "append").parquet(source)
    start_slow_log(spark, source, sink, mark).awaitTermination(120)
    assert sorted(values(spark.read.parquet(sink), "request_id")) == [2, 3, 4]
    # Without a checkpoint folder, one below the shared folder of the session is used.
    start_slow_log(spark, source, sink + "2").awaitTermination(120)
    assert spark.read.parquet(sink + "2").count() == 3
    assert os.path.isdir(os.path.join(spark.conf.get("spark.checkpoint.dir"), "slow_log"))


def test_samples_limit_each_stratum_before_the_shuffle(spark):
    # One stratum holds most rows.
    rows = spark.range(50_000).selectExpr("id", "IF(id % 10 = 0, id % 7, NULL) AS a", "id % 2 AS b")
    sample = sampling.first_per_stratum(rows, ("a", "b"), "id", 2)
    expected, seen = [], {}
    for r in rows.orderBy("id").collect():
        seen[(r.a, r.b)] = seen.get((r.a, r.b), 0) + 1
        if seen[(r.a, r.b)] <= 2:
            expected.append(r.id)
    assert sorted(values(sample, "id")) == expected
    plan = plan_of(sample)
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2


def test_sample_cascade(supplied):
    chosen = sampling.sample_observations(supplied)
    places = sampling.sample_locations(supplied)
    taxa = set(values(sampling.sample_taxa(supplied), "taxon_id"))
    assert set(values(chosen, "taxon_id")) <= taxa
    assert set(values(places, "location_id")) == set(values(chosen, "location_id"))
    kept = sampling.sampled_rows(supplied.location, places, "location_id")
    assert kept.count() == places.count()


def test_tables(spark, make, tmp_path):
    tables = make.tables(taxon_group=[{"taxon_group_id": 1, "name": "n"}])
    with pytest.raises(AttributeError):
        tables.nothing
    tables.taxon_group.write.parquet(str(tmp_path / "taxon_group"))
    read = OccurrenceTables.from_parquet(spark, str(tmp_path)).taxon_group
    assert values(read, "taxon_group_id", "name", "is_deleted") == [(1, "n", None)]
