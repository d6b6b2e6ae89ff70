"""Trees of any depth against walks from node to node."""

from __future__ import annotations

import random

import pytest

from sightlines.operators import trees as T


def frame(spark, parents):
    return spark.createDataFrame(list(parents.items()), "node string, parent string")


def walked(parents):
    out = []
    for node in parents:
        at, distance = node, 0
        while at in parents:
            out.append((at, node, distance))
            at, distance = parents[at], distance + 1
    return out


def _random(seed, n):
    r = random.Random(seed)
    parents = {"n00": None}
    for i in range(1, n):
        parents[f"n{i:02}"] = r.choice([*list(parents)[-3:], "gone", None]) if i % 9 == 0 else r.choice(list(parents)[-3:])
    return parents


TREES = [
    {}, {"a": None}, {"a": "elsewhere", "b": "a"}, {f"c{i:02}": f"c{i - 1:02}" if i else None for i in range(37)},
    {"root": None, **{f"k{i:02}": "root" for i in range(30)}}, _random(1, 60), _random(2, 45),
]


@pytest.mark.parametrize("parents", TREES)
def test_closure_labels_and_rollup(spark, parents):
    nodes = frame(spark, parents)
    pairs = T.closure(nodes)
    expected = sorted(walked(parents))
    assert sorted(map(tuple, pairs.collect())) == expected
    intervals = {r.node: (r.first, r.last) for r in T.labels(nodes, pairs).collect()}
    assert sorted(first for first, _ in intervals.values()) == list(range(len(parents)))
    inside = {(a, d) for a in parents for d in parents if intervals[a][0] <= intervals[d][0] <= intervals[a][1]}
    assert inside == {(a, d) for a, d, _ in expected}
    counts = {node: i for i, node in enumerate(parents) if i % 2}
    sums: dict = {}
    for a, d, _ in expected:
        if d in counts:
            sums[a] = sums.get(a, 0) + counts[d]
    counted = spark.createDataFrame(list(counts.items()), "node string, n long")
    assert dict(map(tuple, T.rolled_up(pairs, counted).collect())) == sums


@pytest.mark.parametrize("parents", [{"a": "a"}, {"a": "b", "b": "a", "c": "b"}, {"r": None, "x": "z", "y": "x", "z": "y"}])
def test_cycles_are_refused(spark, parents):
    with pytest.raises(ValueError, match="cycle"):
        T.closure(frame(spark, parents))


def test_nodes_have_one_row(spark):
    with pytest.raises(ValueError, match="two rows"):
        T.closure(spark.createDataFrame([("a", None), ("a", "b")], "node string, parent string"))
    assert T.closure(spark.createDataFrame([(None, "b"), ("b", None)], "node string, parent string")).count() == 1
