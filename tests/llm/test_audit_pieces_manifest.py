"""Source audit, SentencePiece and Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sightlines.llm import merkle, queries, ranks, sentence_piece, source_audit
from tests.conftest import plan_of
from tests.test_queries import _normal

from . import cases

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    letters = lambda: "".join(r.choice("abé") for _ in range(r.choice([1, 2, 3, 4, 5, 8, 9, 17, 40])))
    vocabulary = [letters() for _ in range(60)] + ["stem" + "x" * n for n in (0, 1, 4, 60, 61)] + ["ß" * 300]
    text = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(60)))
    out = [(i, text(), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, "é"]), 7) for i in range(120)]
    out += [(200, None, "en", "bare", 0), (201, "", "fr", "x", 0), (202, "1 2 3", "fr", "y", None), (203, "Solo", "xx", "z", 1)]
    return out + [out[0], out[0], (None, "A b\x00c", None, None, None), (None, None, None, None, None)] + cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(*r, *["x"] * 8) for r in rows]
    frame = spark.createDataFrame(wide, cases.DOCS + cases.CLASHING)
    return frame.withColumns({"tree": F.lit("x"), "rank": F.lit(1), "leaf": F.lit("y")}).repartition(3)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    """The odd rows as a table of documents."""
    root = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{root}/documents.parquet")
    return root


def test_postings_are_not_sorted_to_meet_kept_prefixes(spark, monkeypatch):
    """Neither by a broadcast nor by a shuffle."""
    rows = spark.createDataFrame([("en", b"a"), ("en", b"b"), ("de", b"a"), ("en", b"a")], "lang string, prefix binary")
    kept = spark.createDataFrame([("en", b"a")], "lang string, prefix binary")
    for most, join in ((source_audit.BROADCAST_BYTES, "BroadcastHashJoin"), (-1, "ShuffledHashJoin")):
        monkeypatch.setattr(source_audit, "BROADCAST_BYTES", most)
        below = source_audit._below(rows, kept)
        assert join in plan_of(below) and "SortMergeJoin" not in plan_of(below)
        assert [tuple(r) for r in below.collect()] == [("en", b"a")] * 2


def _audit(rows):
    kept, groups = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        found = Counter(TERM.findall((text or "").translate(cases.LOWER)))
        kept[lang or ""].update(found.keys())
        groups[lang or "", source or ""].update(found)
    out = []
    for (lang, source), counts in groups.items():
        terms = sorted(t for t, n in kept[lang].items() if n >= 3)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in terms) + len(terms)) for t in terms}
        p = share(counts)
        values = {}
        for (other, item), theirs in groups.items():
            if other == lang and item != source:
                q = share(theirs)
                values["pair", item] = sum((p[t] - q[t]) ** 2 // q[t] for t in terms)
        q = share(sum((c for (o, _), c in groups.items() if o == lang), Counter()))
        values |= {("term", t): (p[t] - q[t]) ** 2 // q[t] for t in terms if counts[t] and p[t] > q[t]}
        for part in ("pair", "term"):
            items = sorted((-v, i.encode(), i) for (a, i), v in values.items() if a == part)
            out += [(lang, source, part, i, -v, k + 1) for k, (v, _, i) in enumerate(items) if part == "pair" or k < 200]
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_source_audit(spark, docs, rows, monkeypatch, odd):
    if odd:  # many tiles, many blocks, joins by shuffle
        monkeypatch.setattr(source_audit, "TILE_SOURCES", 2)
        monkeypatch.setattr(source_audit, "TILE_TERMS", 7)
        monkeypatch.setattr(source_audit, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(source_audit, "GATHERED", 50)
        monkeypatch.setattr(source_audit, "FIRST_LENGTH", 1)
        monkeypatch.setattr(ranks, "LEAST_ROWS", 5)
    found = source_audit.audited(docs)
    assert sorted(map(tuple, found.collect())) == sorted(_audit(rows))


def test_prefixes_are_refined_to_kept_terms(docs, rows):
    posted = source_audit.postings(docs)
    expected = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        expected[lang or ""].update(set(TERM.findall((text or "").translate(cases.LOWER))))
    found = {(r.lang, bytes(r.term)) for r in source_audit.kept_terms(posted, 5).collect()}
    assert found == {(g, t.encode() + b"\0") for g, c in expected.items() for t, n in c.items() if n >= 5}


def test_entries_need_no_sort(spark):
    totals = spark.createDataFrame([("nb", "a", b"x\0", 3), ("nb", "b", b"x\0", 1)], "lang string, source string, term binary, count long")
    names = "lang string, source string, total long, terms_kept long, rank long, size long, zero long"
    sources = spark.createDataFrame([("nb", "a", 3, 1, 0, 2, 1), ("nb", "b", 1, 1, 1, 2, 1)], names)
    numbered = spark.createDataFrame([("nb", b"x\0", 4, 0, 0)], "lang string, term binary, whole long, block long, number long")
    found = source_audit._entries(totals, sources, numbered)
    assert [*map(tuple, found.orderBy("source").select("source", "number", "p").collect())] == [("a", 0, 10**9 + 1), ("b", 0, 10**9 + 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_source_audit_of_nothing(spark):
    assert source_audit.audited(spark.createDataFrame([], cases.DOCS)).count() == 0


def test_source_audit_equals_sql(spark, folder):
    _equals_sql(spark, folder, "op11_source_audit")


def _equals_sql(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    relation = connection.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in relation.description]
    assert sorted(columns) == sorted(df.columns)
    assert _normal(df.columns, [tuple(r) for r in df.collect()]) == _normal(columns, relation.fetchall())


def test_sentence_piece(docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = sentence_piece.decoded(sentence_piece.encoded(docs, MODEL), MODEL)
    assert {"digest", "class", "key", "tree"} <= set(found.columns)
    got = sorted((repr(r.doc_id), repr(r.text), list(r.ids), r.n_tokens, r.decoded) for r in found.collect())
    expected = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        expected.append((repr(doc), repr(text), ids, len(ids), library.decode(ids)))
    assert got == sorted(expected)
    assert all(r.agrees and r.decodes for r in found.select("agrees", "decodes").collect())


def test_agenda_and_decoder_equal_the_library(monkeypatch):
    monkeypatch.setattr(sentence_piece, "REMEMBERED", 20)
    pieces, r = sentence_piece.Pieces(MODEL), random.Random(4)
    parts = list("abthein \n\t▁é😀漢字Ａﬁ​\x00<>s/0x41_-\r") + ["  ", "the", " and", "▁▁", " " * 40, "</s>"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(50)))
        ids = pieces.library.encode(text, add_eos=True)
        found, agrees = pieces.encode([text])
        assert np.frombuffer(found[0], "<i4").tolist() == ids and agrees == [True]
        assert pieces.merged(pieces.library.normalize(text)) == ids[:-1] and pieces.decode(ids) == pieces.library.decode(ids)
        ids = [r.choice([r.randrange(32000), r.randrange(270), 28705]) for _ in range(r.randrange(9))]
        assert pieces.decode(ids) == pieces.library.decode(ids)


def test_sentence_piece_digests(spark, folder, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        expected.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True))
    found = queries.op12_sentence_piece(spark, folder)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_sentence_piece_of_nothing(spark):
    empty = spark.createDataFrame([], cases.DOCS)
    assert sentence_piece.decoded(sentence_piece.encoded(empty, MODEL), MODEL).count() == 0


def _hash(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _tree(hashes):
    """Root and, per leaf, its (left, right) siblings."""
    proofs, places, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for proof, place in zip(proofs, places):
            other = place ^ 1
            proof.append((level[other], "") if other < place else ("", level[other] if other < len(level) else ""))
        level = [_hash(*level[i : i + 2]) for i in range(0, len(level), 2)]
        places = [place >> 1 for place in places]
    return level[0], proofs


def _manifest(rows):
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = lambda size: _hash(*map(_field, (doc, source, lang, size, text)))
        hit = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        groups[lang].append((doc is not None, doc or 0, leaf(n), leaf(n + 1) if hit else leaf(n), doc))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([leaf for _, _, leaf, *_ in sorted(groups[g])]) for g in langs}
    root, above = _tree([trees[g][0] for g in langs])
    out = []
    for g, upper in zip(langs, above):
        for (_, _, leaf, folded, doc), proof in zip(sorted(groups[g]), trees[g][1]):
            for left, right in proof + upper:
                folded = _hash(left, folded, right)
            flat = _hash(*(s for pair in proof + upper for s in pair))
            out.append((doc, leaf, trees[g][0], root, flat, folded, folded == root))
    return out


@pytest.mark.parametrize("bits, digits, least", [(5, 2, 10_000), (1, 1, 5), (2, 1, 7), (1, 3, 1)])
def test_manifest(spark, folder, rows, monkeypatch, bits, digits, least):
    """Blocks of a few leaves, so that all tiers are there, and ranges of a few rows."""
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(ranks, "LEAST_ROWS", least)
    found = queries.op13_merkle_manifest(spark, folder)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_manifest(rows), key=repr)


def test_manifest_equals_sql(spark, folder):
    _equals_sql(spark, folder, "op13_merkle_manifest")


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], cases.DOCS)
    leaf = merkle.digest_of([F.col("doc_id")])
    row = merkle.manifest(one, leaf, "doc_id", "lang", {}).first()
    assert row.leaf == row.subroot == row.root == _hash("1:1") and row.proof == []
    assert merkle.manifest(one.limit(0), leaf, "doc_id", "lang", {}).count() == 0


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "LEAST_ROWS", 3)
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randrange(9), i) for i in range(100)]
    path = spark.createDataFrame(rows, "g string, x int, id int")
    found = sorted(map(tuple, ranks.ranked(path, "g", ["x", "id"]).collect()), key=repr)
    expected = []
    for g in ("a", "b", None):
        own = sorted((x, i) for h, x, i in rows if h == g)
        expected += [(g, x, i, k, len(own)) for k, (x, i) in enumerate(own)]
    assert found == sorted(expected, key=repr)
