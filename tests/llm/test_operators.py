"""The operators against plain versions, on small tables with odd rows."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import time
import zipfile
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sightlines.llm import (
    byte_bpe, chat_rotation, common, decontamination, divergence, html_content, licenses, near_dedup, substring_dedup, toxicity,
    warc_zip,
)
from sightlines.llm.components import components

from . import cases

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(*r, *["x"] * 8) for r in rows]
    return spark.createDataFrame(wide, cases.DOCS + cases.CLASHING).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.DOCS)


def _sorted(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def test_stored_tables_leave_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage, on top of the tables themselves."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*")}
    settings = {key: spark.conf.get(key) for key in common._WRITING}
    before = shuffles()
    rows = common.stored(spark.range(1000).groupBy(F.expr("id % 7 AS k")).count(), "counts")
    for _ in range(100):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 7 and settings == {key: spark.conf.get(key) for key in common._WRITING}


def test_stored_tables_are_made_of_small_batches(spark):
    docs = spark.range(0, 200, 1, 1).selectExpr("id", "repeat('a b ', 25000) AS text")
    found = common.appended(docs, ["text"], lambda c: {"together": [len(c["text"])] * len(c["text"])}, "together int")
    assert common.stored(found, "batches").agg({"together": "max"}).first()[0] <= 100


def test_texts_know_the_sides_they_are_needed_on(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in (1, 2, 3, 4, 5, 2)], "doc_id long, text string")
    met = spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "doc_id long, of long")
    found = substring_dedup._texts(docs, met, spark.createDataFrame([(4,), (2,)], "doc_id long"))
    assert sorted(map(tuple, found.select("doc_id", "text", "later", "first").collect())) == [
        (1, "text 1", False, True), (2, "text 2", True, True), (3, "text 3", True, False), (4, "text 4", False, False),
    ]


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 9), (9, 8), (8, 8), (None, 3), (5, 2), (2, 5), (140, 1)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**{i: 1 for i in (1, *range(100, 141))}, 7: 7, 8: 7, 9: 7, 2: 2, 5: 2}


def test_near_duplicates(docs, rows):
    found = near_dedup.near_duplicates(docs)
    expected = cases.components(rows)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(rows)
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == expected
    assert all(kept == (doc is None or doc == component) for doc, _, component, kept in got)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in expected.items() if d == c} | {None}


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_near_duplicates_of_a_large_family(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", rounds)
    r = random.Random(9)
    text = cases.prose(r, 200)
    rows = [(i, cases.changed(r, text, r.randrange(0, 6))) for i in range(60)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == cases.components(rows)


@pytest.mark.parametrize("rounds", [1, 3])
def test_near_duplicates_of_a_family_of_many_sizes(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", rounds)
    r = random.Random(11)
    text, rows = cases.prose(r, 220).split(), []
    for i in range(400):
        words = (rows[r.randrange(len(rows))][1].split() if i % 3 == 0 and rows else text).copy()
        for _ in range(r.randrange(4)):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = [f"w{r.randrange(40)}"] * r.randrange(3)
        cut = r.choice([0, 0, 5, 12, 25, 33])
        rows.append((i, " ".join(words[: len(words) - cut])))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == cases.components(rows)


def test_size_bands(spark):
    sizes = spark.range(1, 3000).selectExpr("id AS size").selectExpr("size", f"{near_dedup._band('size')} AS band")
    bands = [band for _, band in sorted(map(tuple, sizes.collect()))]
    assert bands[:64] == list(range(1, 65)) and {b - a for a, b in zip(bands, bands[1:])} == {0, 1}


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.deduplicated(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.integers(1, 9))
def test_compact_windows_cover_each_subsequence_once(values, width):
    array = np.array(values, np.uint64)
    covered = {}
    for left, c, right in substring_dedup.compact_windows(array, width):
        for i in range(left, c + 1):
            for j in range(max(c, i + width - 1), right + 1):
                assert (i, j) not in covered
                covered[i, j] = c
    spans = [(i, j) for i in range(len(values)) for j in range(i + width - 1, len(values))]
    assert covered == {(i, j): i + int(array[i : j + 1].argmin()) for i, j in spans}


def test_repeated_passages(docs, rows):
    texts = {d: cases.words(t) for d, t, *_ in rows if d is not None}
    found = substring_dedup.repeats(docs).collect()
    marked = {r.doc_id: {k for p in r.passages for k in range(p.start, p.end)} for r in found}
    assert all(len(marked[r.doc_id]) == r.n_repeated for r in found)
    first = {}
    for doc in sorted(texts):
        for i in range(len(texts[doc]) - 50):
            window = " ".join(texts[doc][i : i + 51])
            if first.setdefault(window, doc) != doc:
                assert set(range(i, i + 51)) <= marked[doc]
    for r in found:  # no passage without a source that resembles it
        for p in r.passages:
            a, b = texts[r.doc_id][p.start : p.end], texts[p.of][p.of_start : p.of_end]
            x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
            assert p.of < r.doc_id and p.end - p.start >= 51 and len(x & y) >= 0.8 * len(x | y)
    clean = [d for d, t, *_ in rows[23:31]]
    assert not set(clean) & set(marked)


def test_passages_behind_a_common_line(spark):
    """The first document of a list shares a line only; two later ones share a passage that holds the line."""
    r = random.Random(3)
    line, passage = cases.prose(r, 40), cases.prose(r, 30)
    texts = [f"{cases.prose(r, 60)} {line} {cases.prose(r, 60)}" for _ in range(6)]
    texts += [f"{cases.prose(r, 60)} {line} {passage} {cases.prose(r, 60)}" for _ in range(2)]
    found = substring_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_repeated) for r in found] == [(7, 70)]


def test_equal_passages_behind_lists_of_others(spark):
    """Lists of the passages begin and end with documents that hold just the line in them, with changing positions."""
    r = random.Random(7)
    line = cases.prose(r, 40)
    alone = lambda: f"{cases.prose(r, 60)} {line} {cases.prose(r, 60)}"
    texts, wanted = [alone() for _ in range(3)], {}
    for _ in range(12):
        before = r.randrange(12)
        passage = f"{cases.prose(r, before)} {line} {cases.prose(r, 11 - before)}".strip()
        texts += [f"{cases.prose(r, 60)} {passage} {cases.prose(r, 60)}" for _ in range(2)]
        wanted[len(texts) - 1] = 51
    texts += [alone() for _ in range(2)]
    found = substring_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeated for r in found} == wanted


def test_near_equal_passages_behind_lists_of_others(spark):
    """All lists of a passage begin with documents that hold too little of it; no 51 words are equal."""
    r = random.Random(17)
    apart = lambda words: f"{cases.prose(r, 60)} {' '.join(words)} {cases.prose(r, 60)}"
    texts, wanted = [], {}
    for _ in range(8):
        words = cases.prose(r, 66).split(" ")
        texts += [apart(words[k : k + 36]) for k in (0, 10, 20, 30) for _ in range(8)]
        texts += [apart(words), apart([*words[:30], "other", *words[31:]])]
        wanted[len(texts) - 1] = 66
    found = substring_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeated for r in found} == wanted


def test_near_equal_passages(spark):
    """Passages of 51 words with one other word in the middle: similarity 42 / 52, found but for one in ten thousand."""
    r = random.Random(11)
    texts = []
    for k in range(200):
        words = [f"v{k}x{i}" for i in range(51)]
        texts += [" ".join(words), " ".join([*words[:25], f"other{r.randrange(10**6)}", *words[26:]])]
    found = substring_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_repeated) for r in found) == [(2 * k + 1, 51) for k in range(200)]


@pytest.mark.parametrize("size, earlier", [(51, 20), (104, 34)])
def test_passages_whose_beginning_stands_further_up(size, earlier):
    """The other text quotes the beginning of the passage before it; a fifth of the tokens and more occur there first."""
    r = random.Random(6)
    passage = cases.prose(r, size)
    quoted = " ".join(passage.split(" ")[:earlier])
    left = f"{cases.prose(r, 80)} {passage} {cases.prose(r, 80)}"
    right = f"{cases.prose(r, 30)} {quoted} {cases.prose(r, 200)} {passage} {cases.prose(r, 30)}"
    found = substring_dedup.matched(substring_dedup.tokens(left), substring_dedup.tokens(right))
    tokens = {k for a, b, *_ in found for k in range(a, b + 1)}
    assert tokens >= set(range(80, 80 + size - 4))
    near = substring_dedup.tokens(left.replace(passage, cases.changed(r, passage, 1)))
    found = substring_dedup.matched(near, substring_dedup.tokens(right))
    assert any(abs(c - 230 - earlier) <= 8 for _, _, c, _, s in found if s >= 0.8)


def test_unlike_texts_are_told_by_their_shared_tokens(monkeypatch):
    r = random.Random(8)
    line = cases.prose(r, 40)
    left, right = (substring_dedup.tokens(f"{cases.prose(r, 200)} {line} {cases.prose(r, 200)}") for _ in range(2))
    monkeypatch.setattr(substring_dedup, "_pieces", lambda *_: pytest.fail("compared"))
    assert substring_dedup.matched(left, right) == []


@pytest.mark.parametrize("text", [None, "", " \n", "one", " Å b\tB\x0b\x1cc ", "a\x00b  ab ba", "x" * 3000 + " y " + "x" * 3000, "ab ba " * 9])
def test_words_are_hashed_all_at_a_time(text):
    words, data = common.space_words(text), substring_dedup._bytes(text)
    found = substring_dedup.word_hashes(data)
    assert len(found) == len(words) and len(set(found.tolist())) == len(set(words))
    assert [len({f for f, w in zip(found.tolist(), words) if w == word}) for word in set(words)] == [1] * len(set(words))
    for start, end in [(0, 1), (1, 3), (0, 99), (2, 2)]:
        assert substring_dedup.words_from(data, start, end).split() == words[start:end]


def test_texts_without_repeats(docs, rows, empty):
    left = {r.doc_id: r for r in substring_dedup.deduplicated(docs).collect()}
    assert left[0].text == rows[0][1] and left[0].spans == "x" and 3 not in left
    assert all(left[d].text == t and left[d].n_chars == n for d, t, _, _, n in rows[23:31])
    assert substring_dedup.deduplicated(empty).count() == 0 and substring_dedup.repeats(empty).count() == 0
    assert substring_dedup.without_spans("a  b c\nd e", [(1, 3)]) == "a  d e"
    assert substring_dedup.without_spans("a b", [(0, 2)]) == ""


def test_warc_packages(spark, tmp_path, monkeypatch):
    html = ["<p>é", None, "", "<p>é", "<p>é", "x" * 200_000, "y"]
    rows = [(i, f"http://e/{i}\n" if i % 2 else None, h) for i, h in enumerate(html)]
    pages = spark.createDataFrame([*rows, (None, "u", "z")], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: tuple(r)[1:] for r in warc_zip.round_trip(pages).collect()}
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    original = {h or "": i for i, h in enumerate(html)}
    assert got == {None: (1, sha("z"), "response", None)} | {
        i: (len((h or "").encode()), sha(h), *(("response", None) if original[h or ""] == i else ("revisit", original[h or ""])))
        for i, h in enumerate(html)
    }
    assert warc_zip.round_trip(pages.limit(0)).count() == 0
    monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", 1)
    packages = warc_zip.written(pages.coalesce(1), str(tmp_path / "w")).collect()
    assert len(packages) == 8
    names = {n for p in packages for n in zipfile.ZipFile(p.path).namelist()}
    assert names == {warc_zip.ARCHIVE, warc_zip.INDEX}


def test_warc_rows_of_one_page(spark):
    """Repeated ids with other and with equal payloads, null ids, clashing columns."""
    rows = [(1, "aaa"), (1, "bbb"), (2, "aaa"), (2, "aaa"), (3, "ccc"), (None, "aaa"), (None, "ddd"), (None, "ddd"), (3, None)]
    pages = spark.createDataFrame([(i, "u", h, "x", "y") for i, h in rows], "page_id long, url string, html string, digest string, own_id string")
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    expected = [(i, len(h or ""), sha(h or ""), "response", None) for i, h in rows]
    for k in (0, 5):
        expected[k] = (*expected[k][:3], "revisit", 2)
    assert sorted(map(tuple, warc_zip.round_trip(pages).collect()), key=repr) == sorted(expected, key=repr)


class _Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, length, offset):
        return self.getvalue()[offset : offset + length]


def test_zip_directories(monkeypatch):
    for limit in (None, 1):
        if limit:  # makes zipfile write ZIP64 fields for small files
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 1)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        file = _Bytes()
        with zipfile.ZipFile(file, "w") as z:
            z.comment = b"note"
            z.writestr("ä.txt", b"one")
            z.writestr("b/c.txt", b"second" * 100)
        found = warc_zip.members(file)
        assert {n: file.read_at(m.size, m.start) for n, m in found.items()} == {"ä.txt": b"one", "b/c.txt": b"second" * 100}
    with pytest.raises(ValueError):
        warc_zip.members(_Bytes(b"no archive"))


def test_toxicity(spark, empty):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = cases.prose(r, 40, 300) + (f" zork{r.choice('abc')}{r.randrange(30)}" if toxic else "")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "zorka1"), (1000, None), (1001, ""), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.learnt(docs, known)
    got = toxicity.scored(docs, machine).withColumn("held_out", toxicity.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    out = [g for g in got if g.doc_id is not None and g.doc_id < 900 and zlib.crc32(str(g.doc_id).encode()) % 4 == 2]
    assert all(g.held_out for g in out) and np.mean([g.predicted == (g.doc_id % 4 == 0) for g in out]) > 0.97
    again = toxicity.scored(docs.repartition(5), toxicity.learnt(docs.repartition(5), known)).collect()
    assert sorted((g.text or "", g.score) for g in again) == sorted((g.text or "", g.score) for g in got)
    nothing = toxicity.learnt(empty, known.limit(0))
    assert all(0 <= g.score <= 1 for g in toxicity.scored(docs, nothing).collect())


def test_pairs_of_terms_count():
    """Either term alone is harmless, both together are toxic: no sum of weights can tell."""
    r = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(2000):
        a, b = (r.random(2) < 0.5).tolist()
        texts.append(toxicity.terms(" ".join(["insult"] * a + ["group"] * b + [f"w{r.integers(50)}"])))
        labels.append(float(a and b))
    machine = toxicity.fitted(texts, np.array(labels, np.float32))
    score = lambda t: machine.score(toxicity.terms(t))
    assert score("insult group") > 0.5 > max(score("insult"), score("group"), score(""))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a>
</header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="cookie-notice">We use cookies, friend.</div>
<main><article><header><h1>Big &amp; news</h1></header><p>First  para with <b>bold</b>text &lt;x&gt;.<!-- no --><p>Second,
unclosed.<ul><li>Point one<li>Point two</ul><form><label>Mail</label></form><script>var a="</p>";</script>
<section id="comments"><h3>Comments</h3><article class="comment"><p>Nice article, I liked it very much!</p></article></section>
</article></main><aside><p>Related: other stuff to read here today.</p></aside><div id=sidebar>About us.</div><footer>© 2024"""


def test_main_text(spark):
    text = "Big & news\nFirst para with boldtext <x>.\nSecond, unclosed.\nPoint one\nPoint two"
    assert html_content.main_text(PAGE) == text
    odd = ["<", "<p", "<!--", "<script>", "<p title='>", "</p></div>", "plain text, a sentence.", "<p>" * 5000, "&amp;" * 50]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), *[(9, "w", x) for x in odd]]
    got = html_content.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and [g.text for g in got if g.page_id == 1] == [text] * 2
    assert all(g.n_chars == len(g.text) for g in got) and [g.text for g in got if g.url in (None, "v")] == ["", ""]


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.floats(-3, 3), min_size=1, max_size=7),
    st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.floats(0, 2)), max_size=12),
)
def test_minimum_cut(gains, edges):
    edges = [(a, b, c) for a, b, c in edges if a < b < len(gains)]

    def cost(labels):
        own = sum(max(0, -g) if x else max(0, g) for g, x in zip(gains, labels))
        return own + sum(c for a, b, c in edges if labels[a] != labels[b])

    least = min(cost([bool(m >> i & 1) for i in range(len(gains))]) for m in range(1 << len(gains)))
    assert cost(html_content.minimum_cut(gains, edges)) == pytest.approx(least, abs=1e-6)


@pytest.fixture(scope="module")
def coder():
    bpe = byte_bpe.ByteBpe(PATH, PATTERN)
    return bpe, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é日́\n\x1c\x85😀1½'s_-! "), max_size=200))
def test_encoding_equals_the_library(coder, text):
    assert coder[0].encode(text).tolist() == coder[1].encode_ordinary(text)


def test_long_pieces(coder):
    r = random.Random(4)
    for text in ("a" * 3000, "ab" * 2000, " " * 4000, "-=" * 1500, "".join(r.choice("abcdefgh") for _ in range(9000))):
        assert coder[0].encode(text).tolist() == coder[1].encode_ordinary(text)
        cut = r.randrange(len(text))
        left, right = (coder[0].reduced(t.encode()) for t in (text[:cut], text[cut:]))
        assert coder[0].joined(left, right) == coder[0].reduced(text.encode())


def test_round_trip(docs, rows, coder, empty):
    tokens = byte_bpe.decoded(byte_bpe.encoded(docs, PATH, PATTERN), PATH, PATTERN)
    got = sorted(((g.text or "", np.frombuffer(g.ids, "<u4").tolist(), g.n_tokens, bytes(g.data)) for g in tokens.collect()), key=repr)
    want = [(t or "", coder[1].encode_ordinary(t or "")) for _, t, *_ in rows]
    assert got == sorted(((t, ids, len(ids), t.encode()) for t, ids in want), key=repr)
    assert byte_bpe.encoded(empty, PATH, PATTERN).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_contamination(spark, docs, rows, empty, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "SEGMENT_WINDOWS", 9)
    w = rows[0][1].split(" ")
    items = [(1, " ".join(w[:13])), (2, " ".join(w[20:45]) + " other words"), (3, "one two three"), (4, "One"), (5, None),
             (6, ""), (7, " ".join(w[3:10])), (8, "not there at all " * 9), (1, " ".join(w[:13])), (10, "same " * 14),
             (11, " ".join(w[30:42])), (None, "one")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(docs, frame)
    got = [
        (g.doc_id, g.n_words, g.n_hit, g.n_items, hashlib.sha256(",".join(sorted(map(str, g["items"]))).encode()).hexdigest(), g.contaminated)
        for g in found.collect()
    ]
    assert sorted(got, key=repr) == sorted(cases.contamination(rows, items), key=repr)
    assert decontamination.contamination(empty, frame).count() == 0
    assert decontamination.contamination(docs, frame.limit(0)).filter("contaminated OR n_hit > 0").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.integers(1, 8))
def test_winnowing_keeps_one_of_each_run(values, run):
    kept = set(decontamination.kept_places(np.array(values, np.uint64), run).tolist())
    run = min(run, len(values))
    for i in range(len(values) - run + 1):
        assert any(k in kept and values[k] == min(values[i : i + run]) for k in range(i, i + run))


@pytest.mark.parametrize("languages", [0, 2_000])
def test_quality_rules(docs, rows, empty, monkeypatch, languages):
    monkeypatch.setattr(divergence, "BROADCAST_LANGUAGES", languages)
    got = divergence.judged(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((g.doc_id, *(g[n] for n in names)) for g in got), key=repr) == sorted(
        ((d, *cases.base_rules(t)) for d, t, *_ in rows), key=repr
    )
    assert all(not (g.base_failed and g.kept) for g in got)
    assert divergence.judged(empty).count() == 0


def test_divergent_documents(spark):
    r = random.Random(8)
    plain = [" ".join(r.choice(["the", "of", "and", f"word{r.randrange(99)}.", f"item{r.randrange(99)}"]) for _ in range(120)) for _ in range(80)]
    odd = ["".join(r.choice("#*$%&|<>") * 3 + " " for _ in range(120)), " ".join(t.upper() + "!!" for t in plain[0].split())]
    rows = [(i, t, "en") for i, t in enumerate([*plain, *odd])]
    got = {g.doc_id: g.kept for g in divergence.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i in got if not got[i]] == [80, 81]


def test_license_scan(spark, docs, empty):
    mit = licenses.KNOWN[0][1]
    texts = [
        mit, "Copyright (c) 2020 A. Person\n\n" + mit.upper(), mit.replace("sublicense", "sub-license").replace('"', "“"),
        "Some text.\n\n  Released under the MIT Licence!  \nMore.", "Released under the MIT License. And more.", None, "", "...",
    ]
    rows = [*enumerate(texts), (None, texts[3]), (3, texts[3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", licenses.F.lit("x"))
    known = licenses.known_licenses(spark)
    assert _sorted(licenses.scanned(frame, known), "doc_id", "license_id", "n_units", "whole_text") == sorted(
        [(0, "MIT", 0, True), (1, "MIT", 0, True), (2, "MIT", 0, True), (3, "MIT", 2, False), (None, "MIT", 1, False)], key=repr
    )
    assert licenses.scanned(docs, known).count() == 0 and licenses.scanned(empty, known).count() == 0


def test_canonical_form_is_made_once(spark):
    """A filter on the form would be pushed below it and make it a second time; empty texts still have no units."""
    frame = spark.createDataFrame([(1, None), (2, ""), (3, " ...\n\n,"), (4, "One\n\nTWO")], "doc_id long, text string")
    found = licenses.digests(frame, "doc_id")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    digest = lambda unit: hashlib.sha256(unit.encode()).hexdigest()
    expected = [(4, False, digest("one")), (4, False, digest("two")), (4, True, digest("one two"))]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_licenses_of_several_paragraphs(spark):
    mit, isc = licenses.KNOWN[0][1], licenses.KNOWN[3][1]
    text = lambda name: (licenses.TEXTS / f"{name}.txt").read_text()
    bsd, gpl = text("BSD-3-Clause"), text("GPL-3.0-or-later--notice")
    texts = [
        f"A tool.\n\n{mit}\n\nMore text.", "/* " + gpl.replace("\n", "\n * ") + " */\nint main() {}", text("GPL-3.0"),
        f"Read me.\n\n{bsd}\n\nAnd:\n{isc}", text("MPL-2.0"), f"Intro {mit}", mit[:-9], text("Unlicense").replace("\n\n", "\n"),
        "All of it is\nReleased under the\nMIT License.\nBye.",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = licenses.known_licenses(spark)
    want = [
        (0, "MIT", 1, False), (1, "GPL-3.0-or-later", 1, False), (2, "GPL-3.0", 0, True), (2, "GPL-3.0", 1, True),
        (3, "BSD-3-Clause", 1, False), (3, "ISC", 1, False), (4, "MPL-2.0", 0, True), (7, "Unlicense", 1, True), (8, "MIT", 1, False),
    ]
    for words in ((), licenses.WORDS):
        got = _sorted(licenses.scanned(frame, known, words), "doc_id", "license_id", "n_units", "whole_text")
        assert {g[:2] for g in got} >= {w[:2] for w in want} and {g[0] for g in got} == {w[0] for w in want}
        assert all(g in want for g in got if g[0] not in (2, 4)), got
    rows = [(r.license_id, r.text.lower()) for r in known.collect()]
    assert all(any(w in t for w in licenses.WORDS) for _, t in rows)
    assert {"BSD-2-Clause", "GPL-2.0", "LGPL-2.1", "AGPL-3.0-or-later", "CC0-1.0", "Zlib", "BSL-1.0"} <= {i for i, _ in rows}


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yo <|end|>"), (1, 3, "ann", None), (1, 300, None, "x"),
            (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (3, None, "ann", "early"), (3, 1, "ann", "late"), (3, 1, "ann", "late")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("head", licenses.F.lit(1))
    got = {(g.conv_id, g.participant, g.part): g for g in chat_rotation.rotated(frame).collect()}
    assert set(got) == {(1, p, k) for p in ("ann", "bob", "unknown") for k in (0, 1)} | {(3, "ann", 0)}
    ann = got[1, "ann", 0]
    assert ann.rendered == (
        "<|system|>Be kind.<|end|><|assistant|>Hi<|end|><|user name=bob|>Yo < |end|><|end|><|assistant|><|end|>"
    )
    spans = [tuple(map(int, s.split("-"))) for s in ann.mask.split(",")]
    assert [ann.rendered[a:b] for a, b in spans] == ["Hi", ""] and (ann.n_turns, ann.n_masked) == (4, 2)
    assert got[1, "bob", 1].mask == "" and got[3, "ann", 0].n_turns == 3
    assert chat_rotation.rotated(frame.limit(0)).count() == 0
