"""MinHash near-duplicates by an inverted join over signature coordinates.

Documents with the same set of shingles form a class; one member stands for it. Each class has a signature of
``COORDINATES`` min-hashes and is posted under its (coordinate, value) pairs. Linked documents agree in
``LEAST_MATCHES`` coordinates or more (but for a chance below 1e-8, see there), so they meet under one of their
``COORDINATES - LEAST_MATCHES + 1`` rarest pairs (prefix); values nobody shares are passed over, and frequent pairs
outside the prefixes are skipped when candidates are made and only counted in the signatures (skip merging).

A posting list is not expanded into all pairs: each member first meets the list's smallest one, the links found join
members to components, and only members of different components meet further. For that their lists are refined by a
prefix of their rarest shingles, which linked sets share for certain. How long it is depends on both sizes, so each set
is posted under its own band of sizes and that of the partners it waits for. The member with the fewest shingles of its
own, as the original of a family has, meets its lists first. Candidates with enough matches are confirmed on the full
sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import appended, drop_stored, exploded, mixed, shingles, space_words, stored
from .components import components

#: Words of a shingle.
SHINGLE_WORDS = 5
#: Documents are linked when 100 * intersection >= LEAST_PERCENT * union.
LEAST_PERCENT = 85
#: Coordinates of a signature, and how many must agree. Matches of a pair with a similarity of 0.85 are binomial with
#: mean 40.8 and deviation 2.5; fewer than 25 have a probability of 4e-9.
COORDINATES, LEAST_MATCHES = 48, 25
#: Rounds in which lists meet one member of theirs; after them all members of different components meet.
STAR_ROUNDS = 3

_PREFIX = COORDINATES - LEAST_MATCHES + 1
#: Side of the rows in a list whose members all may meet.
_ALL_MEET = 2
#: A set of fewer shingles can't reach the similarity with another set.
_LEAST_SHINGLES = 100 // (100 - LEAST_PERCENT)
_SEEDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
_FACTORS, _OFFSETS = _SEEDS[:COORDINATES] | np.uint64(1), _SEEDS[COORDINATES:]


def signature(values: np.ndarray) -> np.ndarray:
    """Min-hashes of a set of 64-bit values, 32 bits each."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 4096):
        part = values[start : start + 4096, None] * _FACTORS + _OFFSETS
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """The documents with n_shingles, digest of the set (null when empty) and signature (null below 6 shingles)."""

    def rows(columns: dict) -> dict:
        out = {"n_shingles": [], "digest": [], "signature": []}
        for text in columns["text"]:
            values = np.unique(shingles(space_words(text), SHINGLE_WORDS))
            out["n_shingles"].append(len(values))
            out["digest"].append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
            out["signature"].append(signature(values) if len(values) >= _LEAST_SHINGLES else None)
        return out

    return appended(docs, ["text"], rows, "n_shingles long, digest binary, signature array<int>")


def _ranked(posted: DataFrame, total: str) -> DataFrame:
    """(class, key, size, place, own): the keys that several classes have, with their place in the class's, rarest first.

    ``total`` is how many keys the class has; the ``own`` ones that no other class has come first and give no list.
    ``size`` is that of the class's shingle set.
    """
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rank = F.expr("row_number() OVER (PARTITION BY class ORDER BY n, key)")
    of_class = F.expr("count(*) OVER (PARTITION BY class)")
    found = posted.join(shared, "key").withColumns({"rank": rank, "shared": of_class})
    return found.selectExpr("class", "key", "size", f"rank + {total} - shared AS place", f"{total} - shared AS own")


def _postings(classes: DataFrame) -> DataFrame:
    """(class, key, size, own, side): lists of the coordinate-value pairs in the prefixes."""
    posted = classes.select("class", "n_shingles", F.posexplode("signature").alias("place", "value"))
    posted = posted.select("class", F.xxhash64("place", "value").alias("key"), F.col("n_shingles").alias("size"))
    kept = _ranked(posted, str(COORDINATES)).filter(f"place <= {_PREFIX}")
    return kept.selectExpr("class", "key", "size", "own", f"{_ALL_MEET} AS side")


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) those that are linked."""
    left = classes.selectExpr("class AS a", "signature AS sig_a", "n_shingles AS n_a")
    right = classes.selectExpr("class AS b", "signature AS sig_b", "n_shingles AS n_b")
    matches = "aggregate(zip_with(sig_a, sig_b, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x)"
    close = (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(f"100 * least(n_a, n_b) >= {LEAST_PERCENT} * greatest(n_a, n_b) AND {matches} >= {LEAST_MATCHES}")
        .select("a", "b")
    )
    close = close.join(texts.selectExpr("class AS b", "text AS text_b"), "b")
    close = close.join(texts.selectExpr("class AS a", "text AS text_a"), "a")

    def rows(columns: dict) -> dict:
        linked, a, left = [], None, None
        for x, text_a, text_b in zip(columns["a"], columns["text_a"], columns["text_b"]):
            if x != a or left is None:
                a, left = x, np.unique(shingles(space_words(text_a), SHINGLE_WORDS))
            right = np.unique(shingles(space_words(text_b), SHINGLE_WORDS))
            both = len(np.intersect1d(left, right, assume_unique=True))
            linked.append(100 * both >= LEAST_PERCENT * (len(left) + len(right) - both))
        return {"linked": linked}

    return appended(close, ["a", "text_a", "text_b"], rows, "linked boolean").filter("linked").select("a", "b")


def _across(postings: DataFrame, of: DataFrame) -> DataFrame:
    """(key, class, size, own, side, component) of the lists whose members lie in several components."""
    found = postings.join(of, postings["class"] == of.node, "left")
    found = found.select("key", "class", "size", "own", "side", F.coalesce("component", "class").alias("component"))
    several = found.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return found.join(several.filter("low < high"), "key")


def _comparable(size: str, side: str) -> str:
    """Whether a row of a list and another one of this size and side can be linked and meet there."""
    sizes = f"100 * least(size, {size}) >= {LEAST_PERCENT} * greatest(size, {size})"
    return f"(side = {_ALL_MEET} OR side <> {side}) AND {sizes}"


def _band(size: str) -> str:
    """The band of a set size: sizes below 64 have their own, later ones share their leading six bits."""
    bits = f"(length(bin({size})) - 6)"
    return f"if({size} < 64, {size}, {bits} * 32 + shiftright({size}, {bits}))"


def _refined(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """(class, key, size, own, side): lists of shingles for the members of signature lists that span several components.

    Linked sets of n and m shingles share at least ``s = LEAST_PERCENT * (n + m) / (100 + LEAST_PERCENT)``, so, with
    shingles ordered rarest first, one of the first ``n - s + 1`` of one is among the first ``m - s + 1`` of the other.
    A shingle is therefore posted for those bands of partner sizes (see ``_band``) for which it stands early enough, under
    both bands. In a large family the members that differ from all others in too many places have shingles of their own
    there and leave the lists; no linked pair does. In a list of two bands, the two sides meet each other only.
    """
    members = texts.join(lists.select("class").distinct(), "class", "left_semi")

    def rows(columns: dict) -> dict:
        sets = [np.unique(shingles(space_words(t), SHINGLE_WORDS)).view(np.int64) for t in columns["text"]]
        sizes = list(map(len, sets))
        return {
            "class": np.repeat(np.array(columns["class"], np.int64), sizes),
            "key": np.concatenate(sets) if sets else [],
            "size": np.repeat(sizes, sizes),
        }

    held = stored(exploded(members, rows, "class long, key long, size int"), "shingles")
    both = 100 + LEAST_PERCENT
    # the largest partner for which a shingle in this place is still in the prefix
    largest = f"int((100L * size - {both}L * (place - 1)) DIV {LEAST_PERCENT})"
    least = f"int(({LEAST_PERCENT}L * size + 99) DIV 100)"
    ranked = _ranked(held, "size").selectExpr("*", f"{largest} AS largest", f"{least} AS least", f"{_band('size')} AS band")
    waiting = ranked.filter(f"largest > 0 AND {_band('largest')} >= {_band('least')}")
    posted = waiting.selectExpr(
        "class", "key", "size", "own", "band", f"explode(sequence({_band('least')}, {_band('largest')})) AS of_band"
    )
    out = stored(
        posted.selectExpr(
            "class",
            "xxhash64(key, least(band, of_band), greatest(band, of_band)) AS key",
            "size",
            "own",
            f"CASE WHEN band < of_band THEN 0 WHEN band > of_band THEN 1 ELSE {_ALL_MEET} END AS side",
        ),
        "refined",
    )
    drop_stored(held)
    return out


def _components(postings: DataFrame, classes: DataFrame, texts: DataFrame, same: DataFrame) -> DataFrame:
    """(node, component) of the classes that have links, ``same`` (a, b) among them."""
    spark = postings.sparkSession
    found, of = same, spark.range(0).selectExpr("id AS node", "id AS component")
    if not same.isEmpty():
        of = components(found)
    for turn in range(STAR_ROUNDS + 1):
        lists = _across(postings, of)
        if turn == 1:
            postings = _refined(lists, texts)
            lists = _across(postings, of)
        if turn < STAR_ROUNDS:
            # all meet a member of the smallest component, or the one with the fewest keys of its own, or of the largest
            row = "component, class AS other, size, side"
            best = (f"min(struct({row}))", f"min(struct(own, {row}))", f"max(struct({row}))")[turn % 3]
            centre = lists.groupBy("key").agg(F.expr(best).alias("centre"))
            meets = _comparable("centre.size", "centre.side")
            pairs = lists.join(centre, "key").filter(f"component <> centre.component AND {meets}")
            pairs = pairs.selectExpr("least(class, centre.other) AS a", "greatest(class, centre.other) AS b")
        else:
            other = lists.selectExpr("key", "class AS b", "component AS other", "size AS size_b", "side AS side_b")
            meets = _comparable("size_b", "side_b")
            pairs = lists.join(other, "key").filter(f"class < b AND component <> other AND {meets}")
            pairs = pairs.selectExpr("class AS a", "b")
        new = stored(_confirmed(pairs.distinct(), classes, texts), "linked")
        if new.isEmpty():
            continue
        found = found.union(new)
        of = components(found)
    return of


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Of every row of documents: doc_id, n_shingles (size of the shingle set), component_id, kept.

    component_id is the smallest doc_id reachable over links, itself included; kept says that it is the row's own.
    Null and empty texts have no shingles and no links. Rows with a null doc_id can't be linked: their component_id
    is null and they are kept. Rows of one doc_id, repeated or not, are one document to the links.
    """
    sets = stored(shingle_sets(docs.select("doc_id", "text")).drop("text"), "sets")
    members = sets.filter("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest")
    first = stored(members.groupBy("digest").agg(F.min("doc_id").alias("class")), "classes")
    of_class = members.join(first, "digest").groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("b"))
    of_class = stored(of_class, "members")
    # rows of one document with different texts make their classes one
    same = members.join(first, "digest").join(of_class.filter("class < b").select("doc_id", F.col("class").alias("b")), "doc_id")
    same = stored(same.filter("class <> b").selectExpr("class AS a", "b").distinct(), "same")
    standing = first.select(F.col("class").alias("doc_id"), "digest")
    classes = sets.filter("signature IS NOT NULL").join(standing, ["doc_id", "digest"], "left_semi")
    classes = stored(classes.selectExpr("doc_id AS class", "n_shingles", "signature").distinct(), "classes")
    postings = stored(_postings(classes), "postings")
    wanted = postings.select(F.col("class").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    texts = stored(texts.selectExpr("doc_id AS class", "text").distinct(), "texts")
    of = _components(postings, classes, texts, same)
    drop_stored(texts, postings, classes)
    of_class = of_class.select("doc_id", F.col("class").alias("node"))
    return (
        sets.select("doc_id", "n_shingles")
        .join(of_class, "doc_id", "left")
        .join(of, "node", "left")
        .withColumn("component_id", F.coalesce("component", "node", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.expr("coalesce(doc_id = component_id, true)").alias("kept"))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without those that near duplicates with a smaller doc_id stand for; all columns kept."""
    gone = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
