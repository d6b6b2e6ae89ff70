"""Z-order keys and ranges against the plain test of coordinates."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings, strategies as st

from sightlines.operators import locations as L
from sightlines.operators import zorder as Z
from sightlines.operators.filters import Envelope, ObservationFilter, inside_envelope
from tests.conftest import location, observation, values

EDGES = [0, 1, -1, 7, 2**31 - 1, -(2**31), 1 << 30, -(1 << 30), None]


def _key(x: int, y: int) -> int:
    x, y = (min(max(v + Z.SHIFTED, 0), (1 << Z.BITS) - 1) for v in (x, y))
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(Z.BITS))


def test_keys(spark):
    points = [(x, y) for x in EDGES for y in EDGES]
    found = spark.createDataFrame(points, "east int, north int").selectExpr("east", "north", f"{Z.z_key('east', 'north')} AS z")
    for x, y, z in map(tuple, found.collect()):
        assert z == (None if x is None or y is None else _key(x, y))


_PLACE = st.integers(-(2**31), 2**31 - 1) | st.integers(-50, 50)


@settings(max_examples=200, deadline=None)
@given(_PLACE, _PLACE, _PLACE, _PLACE, st.integers(4, 64), st.randoms(use_true_random=False))
def test_ranges_hold_all_keys_of_an_envelope(a, b, c, d, most, r):
    envelope = Envelope(min(a, c), min(b, d), max(a, c), max(b, d))
    ranges = Z.z_ranges(envelope, most)
    assert len(ranges) <= most and all(s <= e for s, e in ranges)
    assert all(e + 1 < s for (_, e), (s, _) in zip(ranges, ranges[1:]))
    corners = [(envelope.min_x, envelope.min_y), (envelope.max_x, envelope.max_y), (envelope.min_x, envelope.max_y)]
    inner = [(r.randint(envelope.min_x, envelope.max_x), r.randint(envelope.min_y, envelope.max_y)) for _ in range(9)]
    for x, y in corners + inner:
        assert any(s <= _key(x, y) <= e for s, e in ranges)


def test_small_envelopes_are_exact():
    keys = {k for s, e in Z.z_ranges(Envelope(2, 3, 6, 5)) for k in range(s, e + 1)}
    assert keys == {_key(x, y) for x in range(2, 7) for y in range(3, 6)}


@pytest.fixture(scope="module")
def places(make, tmp_path_factory):
    r = random.Random(6)
    spread = lambda: r.randrange(-1_000_000, 1_000_000)
    rows = [location(i, east=spread(), north=spread()) for i in range(4_000)] + [location(9_000, east=None, north=None)]
    tables = make.tables(location=rows, observation=[observation(i, i) for i in range(0, 4_000, 7)])
    path = str(tmp_path_factory.mktemp("z") / "location")
    Z.write_z_ordered(tables.location, path, files=40)
    return tables, tables.with_z_ordered_locations(path)


def _rows_read(frame) -> int:
    """Rows that the scan gave, after row groups were ruled out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    stack, read = [plan], 0
    while stack:
        node = stack.pop()
        if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            read += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return read


@pytest.mark.parametrize("box", [(-500, -500.5, 90_000, 80_000), (-1e6, 0, 1e6, 30_000), (0, -1e6, 30_000, 1e6), (5, 5, 6, 6)])
def test_envelopes_read_fewer_row_groups(places, box):
    plain, ordered = places
    envelope = Envelope(*box)
    found, expected = (sorted(values(inside_envelope(t.location, envelope), "location_id")) for t in (ordered, plain))
    assert found == expected
    inside = inside_envelope(ordered.location, envelope)
    assert _rows_read(inside.select("location_id")) < 4_001 / 2
    f = ObservationFilter(envelope=envelope)
    assert L.requested_locations(ordered, f).collect() == L.requested_locations(plain, f).collect()
