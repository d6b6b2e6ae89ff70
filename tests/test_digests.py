"""Digests along a tree: only the way of a change changes, merges equal a new digest."""

from __future__ import annotations

import random

import pytest

from sightlines.operators import digests as D
from sightlines.operators import trees as T

NODES = [("all", None), ("c1", "all"), ("c2", "all"), ("m1", "c1"), ("m2", "c1"), ("m3", "c2"), ("m4", "c2")]


@pytest.fixture(scope="module")
def tree(spark):
    nodes = spark.createDataFrame(NODES, "node string, parent string")
    return nodes, T.closure(nodes)


def _rows(seed=3):
    r = random.Random(seed)
    rows = [(i, r.choice(["m1", "m2", "m3"]), r.choice(["x", None, ""]), [i % 3]) for i in range(60)]
    return rows + rows[:5]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, place string, text string, list array<int>")


def _digest(spark, rows):
    return D.digested(_frame(spark, rows).repartition(5), "place", ["id", "text", "list"])


def _plain(frame):
    return sorted(map(tuple, frame.collect()))


def test_order_does_not_count(spark):
    rows = _rows()
    shuffled = random.Random(9).sample(rows, len(rows))
    assert _plain(_digest(spark, rows)) == _plain(_digest(spark, shuffled))
    assert _plain(_digest(spark, rows)) != _plain(_digest(spark, rows[:-1]))


def test_merge_equals_a_new_digest(spark):
    rows = _rows()
    kept, came, went = rows[:30], rows[30:], [(900, "m4", "gone", [1]), (901, "m1", None, None)]
    merged = D.merged(_digest(spark, kept + went), _digest(spark, came), _digest(spark, went))
    assert _plain(merged) == _plain(_digest(spark, rows))


@pytest.mark.parametrize(
    "change, expected",
    [
        (lambda rows: rows, {}),
        (lambda rows: [(i, p, "other" if i == 7 else t, x) for i, p, t, x in rows], None),
        (lambda rows: rows + [(77, "m4", "new", None)], {"all": "changed", "c2": "changed", "m4": "added"}),
        (lambda rows: [r for r in rows if r[1] != "m3"], {"all": "changed", "c2": "removed", "m3": "removed"}),
        # a null and an empty text change places
        (lambda rows: [(i, p, {None: "", "": None}.get(t, t) if i == 7 else t, x) for i, p, t, x in rows], None),
    ],
)
def test_a_change_changes_its_way_only(spark, tree, change, expected):
    nodes, pairs = tree
    rows = [(i, p, "" if i == 7 else t, x) for i, p, t, x in _rows()]
    before, after = (D.along_tree(pairs, _digest(spark, r)) for r in (rows, change(rows)))
    if expected is None:
        place = next(p for i, p, *_ in rows if i == 7)
        expected = {place: "changed", dict(NODES)[place]: "changed", "all": "changed"}
    assert dict(map(tuple, D.changed(before, after).collect())) == expected
    assert dict(map(tuple, D.changed_below(before, after, nodes, "all").collect())) == expected
