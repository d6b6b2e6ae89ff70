"""The stages over a small folder against plain versions, each on its own input."""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as driver
import corpus_pipeline
from sightlines.llm import queries
from tests.conftest import SMALL
from tests.test_queries import _connect, _normal

from . import cases

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of every stage, by doc_id."""
    root = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(root / name))
        result = spark.read.parquet(str(root / name))
        out[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in result.collect()}, result.columns)
        docs = result
    return out


def test_stages_return_documents(stages):
    names = list(stages)
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "byte_bpe"]
    for name, (before, after, columns) in stages.items():
        assert columns[:5] == DOCUMENT and (columns == DOCUMENT or name == "byte_bpe")
        assert after and set(after) <= set(before)
        if name != "substring_dedup":
            assert all(tuple(after[d])[:5] == tuple(before[d])[:5] for d in after)


def test_toxicity_rejects_labelled_documents(stages, spark):
    before, after, _ = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [d for d in before if labels.get(d) == 0]
    assert sum(d in after for d in clean) >= 0.97 * len(clean)


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages["near_dedup"]
    of = cases.components([tuple(r) for r in before.values()])
    assert set(after) == {d for d, (_, component) in of.items() if d == component}


def test_no_passage_is_left_twice(stages):
    before, after, _ = stages["substring_dedup"]
    first = {}
    for doc in sorted(before):
        words = cases.words(before[doc].text)
        for i in range(len(words) - 50):
            first.setdefault(" ".join(words[i : i + 51]), doc)
    for doc, row in after.items():
        words = cases.words(row.text)
        # a passage that stays was this document's own to keep
        assert all(first.get(" ".join(words[i : i + 51]), doc) == doc for i in range(len(words) - 50))
        assert row.n_chars == len(row.text) or row.text == before[doc].text


def test_contaminated_documents_go(stages, spark):
    before, after, _ = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    found = cases.contamination([tuple(r) for r in before.values()], items)
    assert set(after) == {r[0] for r in found if not r[-1]} and set(after) < set(before)


def test_tokens(stages):
    before, after, _ = stages["byte_bpe"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(after) == set(before)
    for row in after.values():
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(row.text) and row.round_trip


def test_queries_are_registered():
    assert {*queries.queries(), "pipeline"} <= set(driver.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, SMALL)
    relation = _connect(SMALL).execute(queries.oracle_sql()[name])
    columns = [c[0] for c in relation.description]
    assert sorted(columns) == sorted(df.columns)
    assert _normal(df.columns, [tuple(r) for r in df.collect()]) == _normal(columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_give_the_agreed_columns(spark, name):
    wanted = {
        "op1": "doc_id n_shingles component_id kept", "op3": "doc_id n_repeated passages",
        "op4": "page_id payload_bytes payload_digest record_type refers_to", "op5": "doc_id held_out score predicted",
        "op6": "page_id url text n_chars", "op7": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op8": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op12": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    }
    df = queries.queries()[name](spark, SMALL)
    assert set(wanted[name.split("_")[0]].split()) <= set(df.columns)
