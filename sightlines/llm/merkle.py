"""Merkle manifest of a table: one tree per group, the groups' roots under one root, and a proof for every row.

Rows are ranked inside their group. The binary digits of a rank say where a leaf hangs; ``BITS`` of them make one
digit here. Inside blocks of ``BITS * DIGITS`` binary levels the digits are grouped away one after the other, each time
nesting the children as structs below their parent; the first exchange, by block, serves all of them. The roots of
blocks are leaves of the next tier, until a group is one block. On the way down a transform adds each child's siblings
to its parent's proof and an explode makes rows of them. A block and its own proof come together in one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_stored, stored
from .ranks import ranked

#: Binary levels of one digit, and digits grouped away inside a block: blocks hold 1024 leaves.
BITS, DIGITS = 5, 2

_ENTRY = "array<struct<left:string,right:string>>"


def digest_of(values: list[Column]) -> Column:
    """Leaf digest: ``-`` for null, else length in bytes, ``:`` and the value, concatenated and hashed."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: str, proof: str) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.expr(f"aggregate({proof}, {leaf}, (acc, e) -> sha2(concat(e.left, acc, e.right), 256))")


def proof_digest(proof: str) -> Column:
    """One digest over the siblings of a proof, from the leaf up."""
    return F.expr(f"sha2(aggregate({proof}, '', (acc, e) -> concat(acc, e.left, e.right)), 256)")


def manifest(docs: DataFrame, leaf: Column, key: str, group: str, carried: dict[str, Column]) -> DataFrame:
    """Per row: the key, what is carried, leaf, subroot (of its group), root and proof (left and right siblings).

    Leaves ascend by key inside a group, groups by name; null comes first in both. Rows with one key are all leaves,
    in the order of their digests. An empty table gives no rows. Only the named columns are read.
    """
    rows = docs.select(
        F.col(group).alias("tree"), F.col(key).alias("key"), leaf.alias("leaf"),
        F.struct(F.col(key).alias(key), *[c.alias(n) for n, c in carried.items()]).alias("row"),
        # tells equal rows apart, so that ranges can part them
        F.monotonically_increasing_id().alias("salt"),
    )
    leaves = stored(rows, "leaves")
    ranks = ranked(leaves, "tree", ["key", "leaf", "salt"])
    drop_stored(leaves)
    nodes = ranks.select("tree", "rank", "size", F.struct(F.col("leaf").alias("hash"), "row").alias("node"))
    found = _rolled(nodes, _forest)
    drop_stored(ranks)
    return found.select("node.row.*", F.col("node.hash").alias("leaf"), "subroot", "root", "proof")


def _forest(tops: DataFrame) -> DataFrame:
    """Proofs of the groups' roots (tree, hash) under the one root."""
    subroots = stored(tops.select(F.lit(0).alias("all"), F.col("tree").alias("name"), "hash"), "subroots")
    ranks = ranked(subroots, "all", ["name"])
    drop_stored(subroots)
    nodes = ranks.select(
        F.col("all").alias("tree"), "rank", "size", F.struct("hash", "name").alias("node")
    )
    root = lambda top: top.select("tree", F.col("hash").alias("root"), F.expr(f"CAST(array() AS {_ENTRY})").alias("proof"))
    found = _rolled(nodes, root)
    drop_stored(ranks)
    return found.select(F.col("node.name").alias("tree"), "root", "proof")


def _rolled(nodes: DataFrame, upper: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes (tree, rank, size, node with a hash) with subroot, root and proof; ``upper`` proves the trees' roots."""
    tiers, base = [], 0
    while True:
        blocks = stored(_blocks(nodes, base), "blocks")
        tiers.append((blocks, base))
        base += BITS * DIGITS
        if blocks.filter("rank > 0").isEmpty():
            break
        nodes = blocks.select("tree", "rank", "size", F.struct("node.hash").alias("node"))
    tops = blocks.select("tree", F.col("node.hash").alias("hash"))
    proved = upper(tops).select("tree", F.lit(0).cast("long").alias("rank"), "root", "proof")
    for blocks, base in reversed(tiers):
        top = base == tiers[-1][1]
        opened = _opened(_met(blocks, proved, top), base)
        proved = opened.select("tree", "rank", "root", "proof", "subroot")
    return opened


def _blocks(nodes: DataFrame, base: int) -> DataFrame:
    """One row per block (tree, rank of the block, size): its node with the hash and, nested, everything below it."""
    digits = [f"shiftright(rank, {BITS * j}) & {(1 << BITS) - 1}" for j in range(DIGITS)]
    frame = nodes.select(
        "tree", "size", F.expr(f"shiftright(rank, {BITS * DIGITS})").alias("block"),
        *[F.expr(f"CAST({d} AS int)").alias(f"d{j}") for j, d in enumerate(digits)], "node",
    ).repartition("tree", "block")
    for j in range(DIGITS):
        keys = ["tree", "size", "block", *[f"d{i}" for i in range(j + 1, DIGITS)]]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{j}").alias("digit"), "node")))
        frame = frame.groupBy(*keys).agg(kids.alias("kids"))
        frame = frame.withColumn("levels", F.expr(_levels(base + BITS * j)))
        frame = frame.select(*keys, F.expr(f"struct(levels[{BITS}][0] AS hash, levels, kids)").alias("node"))
    return frame.select("tree", "size", F.col("block").alias("rank"), "node")


def _levels(base: int) -> str:
    """The digests above ``kids`` level by level; a level at which the tree has ended repeats the one below."""
    pairs = (
        "transform(sequence(0, (size(acc[i - 1]) - 1) div 2),"
        " k -> sha2(concat(acc[i - 1][2 * k], coalesce(get(acc[i - 1], 2 * k + 1), '')), 256))"
    )
    # counted in halves: more than 2^(level - 1) leaves make this level
    step = f"if(shiftright(size - 1, {base - 1} + i) > 0, {pairs}, acc[i - 1])"
    return f"aggregate(sequence(1, {BITS}), array(transform(kids, x -> x.node.hash)), (acc, i) -> concat(acc, array({step})))"


def _met(blocks: DataFrame, proved: DataFrame, top: bool) -> DataFrame:
    """Blocks with the root, subroot and proof of their own node."""
    subroot = F.col("node.hash") if top else F.lit(None).cast("string")
    left = blocks.select(
        "tree", "rank", "size", "node", F.lit(None).cast("string").alias("root"), subroot.alias("subroot"),
        F.expr(f"CAST(NULL AS {_ENTRY})").alias("proof"),
    )
    right = proved.select(
        "tree", "rank", F.lit(None).cast("long").alias("size"), F.lit(None).cast(blocks.schema["node"].dataType).alias("node"),
        "root", (F.lit(None).cast("string") if top else F.col("subroot")).alias("subroot"), "proof",
    )
    names = ["size", "node", "root", "subroot", "proof"]
    return left.union(right).groupBy("tree", "rank").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])


def _opened(blocks: DataFrame, base: int) -> DataFrame:
    """The nodes that were rolled into blocks, each with its proof: its siblings, then what proves its parent."""
    frame = blocks
    for j in reversed(range(DIGITS)):
        level = base + BITS * j
        entry = (
            "if(shiftright(k.digit, i) & 1 = 1,"
            " named_struct('left', node.levels[i][shiftright(k.digit, i) - 1], 'right', ''),"
            " named_struct('left', '', 'right', coalesce(get(node.levels[i], shiftright(k.digit, i) + 1), '')))"
        )
        siblings = f"transform(filter(sequence(0, {BITS - 1}), i -> shiftright(size - 1, {level} + i) > 0), i -> {entry})"
        children = (
            "transform(node.kids, k -> named_struct("
            f"'rank', shiftleft(rank, {BITS}) | k.digit, 'node', k.node, 'proof', concat({siblings}, proof)))"
        )
        frame = frame.select("tree", "size", "root", "subroot", F.explode(F.expr(children)).alias("child"))
        frame = frame.select("tree", "size", "root", "subroot", "child.rank", "child.node", "child.proof")
    return frame


def oracle_sql() -> str:
    """The query over documents in DuckDB's SQL; entries of a proof are texts with their side first."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = f"sha256({' || '.join(part.format(c) for c in columns)})"
    more = {c: "n_chars::HUGEINT + 1" if c == "n_chars" else c for c in columns}
    tampered = f"sha256({' || '.join(part.format(f'({more[c]})') for c in columns)})"
    crc = (
        "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
        " lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],"
        " lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    )
    levels = """SELECT {tree}, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), any_value(n)
        FROM (SELECT *, count(*) OVER (PARTITION BY {tree}) AS c FROM {nodes}) WHERE c > 1
        GROUP BY {tree}, level, pos // 2"""
    entry = """list(CASE WHEN s.hash IS NULL THEN '-' WHEN s.pos < (l.pos >> l.level) THEN 'l' || s.hash
        ELSE 'r' || s.hash END ORDER BY l.level)"""
    joined = "s.level = l.level AND s.pos = xor(l.pos >> l.level, 1)"
    return f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, {leaf} AS leaf,
               CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {tampered} END AS tampered
        FROM documents),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id
        FROM leaves),
    nodes AS (
        SELECT lang, 0 AS level, pos, leaf AS hash, n FROM ranked
        UNION ALL {levels.format(tree="lang", nodes="nodes")}),
    tops AS (
        SELECT lang, hash FROM nodes WHERE (1::BIGINT << level) >= n AND (level = 0 OR (1::BIGINT << (level - 1)) < n)),
    roots AS (
        SELECT 0 AS one, lang, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM tops),
    upper AS (
        SELECT one, 0 AS level, pos, hash, n FROM roots
        UNION ALL {levels.format(tree="one", nodes="upper")}),
    root AS (SELECT hash FROM upper ORDER BY level DESC LIMIT 1),
    low AS (
        SELECT l.id, {entry} AS proof
        FROM (SELECT *, unnest(range(0, 62)) AS level FROM ranked) l
        LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND {joined}
        WHERE (1::BIGINT << l.level) < l.n GROUP BY l.id),
    high AS (
        SELECT l.lang, {entry} AS proof
        FROM (SELECT *, unnest(range(0, 62)) AS level FROM roots) l LEFT JOIN upper s ON {joined}
        WHERE (1::BIGINT << l.level) < l.n GROUP BY l.lang),
    proved AS (
        SELECT r.doc_id, r.leaf, r.tampered, t.hash AS subroot, (SELECT hash FROM root) AS root,
               coalesce(low.proof, []) || coalesce(high.proof, []) AS proof
        FROM ranked r JOIN tops t ON t.lang IS NOT DISTINCT FROM r.lang
        LEFT JOIN low ON low.id = r.id LEFT JOIN high ON high.lang IS NOT DISTINCT FROM r.lang),
    folded AS (
        SELECT *, list_reduce([coalesce(tampered, leaf)] || proof, lambda acc, e: sha256(
            CASE e[1] WHEN 'l' THEN e[2:] || acc WHEN 'r' THEN acc || e[2:] ELSE acc END)) AS folded_root
        FROM proved)
    SELECT doc_id, leaf, subroot, root,
           sha256(array_to_string(list_transform(proof, lambda e: e[2:]), '')) AS proof_sha256,
           folded_root, folded_root = root AS verified
    FROM folded"""
