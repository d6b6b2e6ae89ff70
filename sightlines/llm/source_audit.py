"""How sources of a language differ: kept terms by iceberg prefix refinement, then exact divergences of their shares.

Terms end with a zero byte, which no term holds. Prefixes of 6, 12, 24, ... bytes are counted by distinct documents;
only terms below a kept prefix go on to the next length, until all kept prefixes are complete terms. In a sorted
document a term opens those prefixes that it doesn't share with the term before it, so the documents of a prefix are
the times that a term opened it: no distinct is needed, and rows of one source can be summed in every task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import SLICE_ROWS, drop_stored, stored
from .ranks import ranked

#: Documents of a language that a kept term stands in, at least.
LEAST_DOCUMENTS = 3
#: Length in bytes of the first prefixes; each further level doubles it.
FIRST_LENGTH = 6
#: Terms of documents that a task gathers before it gives their sums.
GATHERED = 1_000_000
#: Ranks of terms that are given for a source.
MOST_TERMS = 200
#: Shares are counted in units of 1 / SCALE; ADDED is added to every count.
SCALE, ADDED = 1_000_000_000, 1
#: Bytes of kept prefixes up to which they are broadcast; more of them are joined by shuffle.
BROADCAST_BYTES = 16_000_000
#: Sources and kept terms of one tile of the comparison.
TILE_SOURCES, TILE_TERMS = 64, 8_192

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)  # ASCII letters in lower case, all bytes of other characters; the rest parts terms


def term_counts(text: str | None) -> Counter:
    """Terms of a text, as bytes, with their occurrences."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def _shared(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes each term shares with the one before it; ``first`` marks the terms with none before."""
    out = np.zeros(len(sizes), np.int32)
    live = np.flatnonzero(~first)
    k = 0
    # distinct terms of one document part before their end bytes do
    while len(live) > 32:
        live = live[data[starts[live] + k] == data[starts[live - 1] + k]]
        k += 1
        out[live] = k
    for i in live.tolist():
        a, b = (data[starts[j] : starts[j] + min(sizes[i], sizes[i - 1])] for j in (i, i - 1))
        out[i] = int((a != b).argmax())
    return out


class _Numbers(dict):
    """Terms of a language with their row."""

    def __init__(self, next_row: Iterator[int]):
        self.next_row = next_row

    def __missing__(self, term: bytes) -> int:
        row = self[term] = next(self.next_row)
        return row


class _Gathered:
    """Terms of documents, summed by language and term, and by source inside."""

    def __init__(self, first_length: int):
        self.first_length = first_length
        self.rows: dict[str, _Numbers] = {}
        self.sources: dict[str, int] = {}
        self.next_row = count()
        self.gathered = 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, langs: list[str], sources: list[str], texts: list[str]) -> None:
        terms: list[bytes] = []
        at, n = [], []
        starts, origin = [], []
        for lang, source, text in zip(langs, sources, texts):
            if not (found := term_counts(text)):
                continue
            if (rows := self.rows.get(lang)) is None:
                rows = self.rows[lang] = _Numbers(self.next_row)
            starts.append(len(terms))
            origin.append(self.sources.setdefault(source, len(self.sources)))
            own = sorted(found)
            terms += own
            # straight into arrays, as a list of numbers would be gone through once more
            at.append(np.fromiter(map(rows.__getitem__, own), np.int64, len(own)))
            n.append(np.fromiter(map(found.__getitem__, own), np.int64, len(own)))
        if not terms:
            return
        first = np.zeros(len(terms), bool)
        first[starts] = True
        sizes = np.fromiter(map(len, terms), np.int64, len(terms)) + 1
        data = np.frombuffer(b"\0".join(terms) + b"\0", np.uint8)
        shared = _shared(data, np.cumsum(sizes) - sizes, sizes, first)
        origins = np.repeat(np.array(origin), np.diff([*starts, len(terms)]))
        self.parts.append((np.concatenate(at), np.concatenate(n), shared, origins))
        self.gathered += len(terms)

    def sums(self) -> pa.RecordBatch:
        """What was gathered, a row for each language and term."""
        at, n, shared, origins = (np.concatenate(column) for column in zip(*self.parts))
        order: list[int] = []
        terms: list[bytes] = []
        for rows in self.rows.values():
            order += rows.values()
            terms += [term + b"\0" for term in rows]
        size, width = len(terms), len(self.sources)
        back = np.empty(size, np.int64)
        back[order] = np.arange(size)
        at = back[at]
        lang = np.repeat(np.arange(len(self.rows)), list(map(len, self.rows.values())))

        pairs = at * width + origins
        order = np.argsort(pairs)
        pairs = pairs[order]
        new = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        pairs, total = pairs[new], np.add.reduceat(n[order], new)
        source = pa.array(list(self.sources), pa.string()).take(pa.array(pairs % width))
        found = pa.StructArray.from_arrays([source, pa.array(total)], ["source", "n"])
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(size + 1) * width), pa.int32()), found)

        sizes = np.fromiter(map(len, terms), np.int64, size)
        length, opened, has = self.first_length, [], []
        above = np.ones(size, bool)
        while above.any():
            opened.append(np.bincount(at[shared < length], minlength=size))
            has.append(above)
            above = sizes > length
            length *= 2
        has = np.stack(has, axis=1)
        values = pa.array(np.stack(opened, axis=1)[has], pa.int64())
        opened = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has.sum(axis=1))], pa.int32()), values)
        langs = pa.array(list(self.rows), pa.string()).take(pa.array(lang))
        columns = [langs, pa.array(terms, pa.binary()), opened, found]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "opened", "found"])


def postings(docs: DataFrame, first_length: int = FIRST_LENGTH, most: int = GATHERED) -> DataFrame:
    """lang, term (binary), opened: documents in which it opens its prefix of each length, found: (source, n).

    There are as many lengths as the term needs; n counts occurrences. A row sums documents of one task, ``most`` or more
    of their terms at a time, so that even a term of every document has few rows. Null text, lang and source are empty.
    Each row of the frame is a document of its own, repeated rows too.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(first_length)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                gathered.add(*(batch.column(c).slice(at, SLICE_ROWS).to_pylist() for c in ("lang", "source", "text")))
                if gathered.gathered >= most:
                    yield gathered.sums()
                    gathered = _Gathered(first_length)
        if gathered.gathered:
            yield gathered.sums()

    ddl = "lang string, term binary, opened array<long>, found array<struct<source:string,n:long>>"
    return rows.mapInArrow(run, ddl)


def _bytes_of(frame: DataFrame, *columns: str) -> int:
    size = sum((F.octet_length(c) for c in columns), F.lit(48))
    return frame.agg(F.sum(size)).first()[0] or 0


def _below(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose (lang, prefix) is kept; the kept prefixes are broadcast only if their measured bytes are few.

    Else both sides are shuffled, and the few kept ones are hashed: the many rows with their lists need no sort.
    """
    few = _bytes_of(kept, "lang", "prefix") <= BROADCAST_BYTES
    kept = F.broadcast(kept) if few else kept.hint("shuffle_hash")
    return rows.join(kept, ["lang", "prefix"], "left_semi")


def kept_terms(posted: DataFrame, least: int = LEAST_DOCUMENTS, first_length: int = FIRST_LENGTH) -> DataFrame:
    """(lang, term): terms that stand in so many documents of a language, by refinement of prefixes. Stored."""
    length, above, done, level_of = first_length, None, [], 0
    while True:
        rows = posted.select("lang", "term", F.expr(f"get(opened, {level_of})").alias("opened"))
        if above is not None:
            # a term that was whole at the level above is decided; the others lie below a prefix of that level
            rows = rows.filter(F.octet_length("term") > length // 2)
            rows = _below(rows.withColumn("prefix", F.expr(f"substring(term, 1, {length // 2})")), above)
        rows = rows.select("lang", F.expr(f"substring(term, 1, {length})").alias("prefix"), "opened")
        counted = rows.groupBy("lang", "prefix").agg(F.sum("opened").alias("documents"))
        level = stored(counted.filter(F.col("documents") >= least).select("lang", "prefix"), "prefixes")
        whole = F.expr("substring(prefix, -1, 1) = X'00'")
        done.append(level.filter(whole))
        above = level.filter(~whole)
        if above.isEmpty():
            break
        length, level_of = length * 2, level_of + 1
    out = done[0]
    for level in done[1:]:
        out = out.union(level)
    return stored(out.withColumnRenamed("prefix", "term"), "terms")


def term_totals(posted: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, count) of kept terms, where they occur. Stored."""
    rows = posted.select("lang", F.col("term").alias("prefix"), "found")
    rows = _below(rows, kept.withColumnRenamed("term", "prefix"))
    rows = rows.select("lang", F.col("prefix").alias("term"), F.explode("found").alias("one"))
    found = rows.groupBy("lang", F.col("one.source").alias("source"), "term").agg(F.sum("one.n").alias("count"))
    return stored(found.select("lang", "source", "term", "count"), "totals")


def _share(count: str, total: str, kept: str) -> str:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exactly."""
    below = f"greatest(CAST({total} AS decimal(25,0)) + {ADDED} * {kept}, CAST(1 AS decimal(25,0)))"
    share = f"CAST({SCALE} * (CAST({count} AS decimal(25,0)) + {ADDED}) AS decimal(38,0)) div {below}"
    return f"CAST(1 + ({share}) AS long)"


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of shares; shares are at most SCALE + 1, so the square fits."""
    return (p - q) ** 2 // q


def compared(a: dict, b: dict, terms: int, same: bool) -> dict[str, list]:
    """Sums of gaps between the sources of two tiles over the kept terms of one block.

    A tile has ``source`` and ``zero`` (share of a term that does not occur) per source, and entries (``of``: place of
    the source, ``term``: number of the term, ``p``). Terms that occur in neither tile count with both zero shares.
    """
    seen = np.unique(np.concatenate([a["term"], b["term"]]))
    shares = []
    for tile in (a, b):
        matrix = np.repeat(tile["zero"][:, None], len(seen), axis=1)
        matrix[tile["of"], np.searchsorted(seen, tile["term"])] = tile["p"]
        shares.append(matrix)
    absent = terms - len(seen)
    out: dict[str, list] = {"source": [], "item": [], "value": []}
    for (left, p), (right, q) in [((a, shares[0]), (b, shares[1]))] + [((b, shares[1]), (a, shares[0]))] * (not same):
        for i, source in enumerate(left["source"]):
            value = _gap(p[i], q).sum(axis=1) + absent * _gap(left["zero"][i], right["zero"])
            others = [j for j, item in enumerate(right["source"]) if item != source]
            out["source"] += [source] * len(others)
            out["item"] += [right["source"][j] for j in others]
            out["value"] += value[others].tolist()
    return out


def _tile_of(table: pa.Table) -> dict:
    """A tile from its rows: one with a name and the number -1 per source, and its entries."""
    rank, term, p = (table.column(c).to_numpy() for c in ("rank", "number", "p"))
    names = np.flatnonzero(term < 0)
    names = names[np.argsort(rank[names])]
    entries = term >= 0
    return {
        "source": table.column("source").take(pa.array(names)).to_pylist(), "zero": p[names],
        "of": np.searchsorted(rank[names], rank[entries]), "term": term[entries], "p": p[entries],
    }


def _entries(totals: DataFrame, sources: DataFrame, numbered: DataFrame) -> DataFrame:
    """The totals with what is known of their source and term, and the term's share in the source.

    A term has a row for each of its sources in the totals and one number: numbers are hashed, totals need no sort.
    """
    found = totals.join(sources, ["lang", "source"]).join(numbered.hint("shuffle_hash"), ["lang", "term"])
    return found.withColumn("p", F.expr(_share("count", "total", "terms_kept")))


def _pairs(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums over all kept terms for any two sources of a language.

    Blocks of kept terms meet tiles of sources; every group holds two tiles of one block, so its size is bounded
    however many sources or terms a language has. A tile is sent once to each tile it meets.
    """
    columns = ["lang", "block", "terms_kept", "size", "rank", "source", "number", "p"]
    blocks = F.explode(F.expr(f"sequence(0L, greatest(terms_kept - 1, 0) div {TILE_TERMS})"))
    named = sources.withColumns({"block": blocks, "number": F.lit(-1).cast("long"), "p": F.col("zero")})
    rows = entries.withColumn("source", F.lit(None).cast("string")).select(*columns).union(named.select(*columns))
    rows = rows.withColumn("tile", F.expr(f"rank div {TILE_SOURCES}"))
    rows = rows.withColumn("met", F.explode(F.expr(f"sequence(0L, (size - 1) div {TILE_SOURCES})")))
    rows = rows.withColumns({"low": F.least("tile", "met"), "high": F.greatest("tile", "met")})

    def sums(table: pa.Table) -> pa.Table:
        lang, block, kept, low, high = (
            table.column(c)[0].as_py() for c in ("lang", "block", "terms_kept", "low", "high")
        )
        tile = table.column("tile").to_numpy()
        a, b = (_tile_of(table.filter(pa.array(tile == t))) for t in (low, high))
        found = compared(a, b, min(TILE_TERMS, kept - block * TILE_TERMS), low == high)
        langs = pa.array([lang] * len(found["value"]), pa.string())
        names = {k: pa.array(found[k], pa.string()) for k in ("source", "item")}
        return pa.table({"lang": langs, **names, "value": pa.array(found["value"], pa.int64())})

    keys = ["lang", "block", "low", "high"]
    found = rows.groupBy(*keys).applyInArrow(sums, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others and from it all.

    Part ``pair``: the gap to each other source of the language, over all kept terms, zero without any. Part ``term``:
    the terms that are more frequent in the source than in the language, ``most`` of them. Ranks go by descending value,
    then item by bytes. Null text, lang and source are empty; a source without terms has the shares of zero counts; an
    empty table gives no rows; only the three named columns are read.
    """
    posted = stored(postings(docs, FIRST_LENGTH, GATHERED), "postings")
    kept = kept_terms(posted, least, FIRST_LENGTH)
    totals = term_totals(posted, kept)
    drop_stored(posted, kept)

    whole = stored(totals.groupBy("lang", "term").agg(F.sum("count").alias("whole")), "whole")
    numbered = ranked(whole, "lang", ["term"]).select(
        "lang", "term", "whole", F.expr(f"rank div {TILE_TERMS}").alias("block"), F.expr(f"rank % {TILE_TERMS}").alias("number")
    )

    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = totals.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = whole.groupBy("lang").agg(F.count("*").alias("terms_kept"), F.sum("whole").alias("whole_total"))
    sources = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    sources = ranked(stored(sources.na.fill(0), "sources"), "lang", ["source"])
    sources = sources.withColumn("zero", F.expr(_share("0", "total", "terms_kept")))

    entries = stored(_entries(totals, sources, numbered), "entries")

    pairs = _pairs(entries, sources).withColumn("part", F.lit("pair"))
    above = entries.withColumn("q", F.expr(_share("whole", "whole_total", "terms_kept"))).filter("p > q")
    terms = above.select(
        "lang", "source", F.lit("term").alias("part"),
        F.expr("CAST(substring(term, 1, octet_length(term) - 1) AS string)").alias("item"),
        F.expr("(p - q) * (p - q) div q").alias("value"),
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    names = ["lang", "source", "part", "item", "value", "rank"]
    terms = terms.withColumn("rank", rank).filter(F.col("rank") <= most)
    return pairs.withColumn("rank", rank).select(*names).union(terms.select(*names))


def oracle_sql() -> str:
    """The query over documents in DuckDB's SQL, with a row for each source and kept term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = f"1 + ({SCALE}::HUGEINT * ({{0}} + {ADDED})) // ({{1}} + {ADDED} * v)"
    return rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), '{upper}', '{lower}') AS text
        FROM documents),
    found AS (
        SELECT id, lang, source, term, count(*) AS n
        FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs)
        GROUP BY ALL),
    kept AS (
        SELECT lang, term, sum(n) AS whole FROM found GROUP BY lang, term HAVING count(*) >= {LEAST_DOCUMENTS}),
    counts AS (SELECT lang, source, term, sum(n) AS c FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    dense AS (
        SELECT lang, source, term, whole, coalesce(c, 0) AS c,
               count(*) OVER (PARTITION BY lang, source) AS v,
               sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) AS total,
               sum(whole) OVER (PARTITION BY lang, source) AS whole_total
        FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
    shares AS (
        SELECT lang, source, term, c, {share.format("c", "total")} AS p, {share.format("whole", "whole_total")} AS q
        FROM dense),
    sums AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY ALL),
    result AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE c > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM result)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
    WHERE part = 'pair' OR rank <= {MOST_TERMS}"""
