"""Shapes: parsing, boxes, clipping, markers, features."""

from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightlines.functions import visible as V
from sightlines.functions import wkt as W
from sightlines.operators import geometry as G
from sightlines.operators.filters import Envelope, ObservationFilter
from tests.conftest import area, location, observation, plan_of, values

SQUARE = "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))"
# A "U": the centroid of the whole lies in the gap.
CUP = "POLYGON ((0 0, 0 10, 2 10, 2 2, 8 2, 8 10, 10 10, 10 0, 0 0))"
TWO = "MULTIPOLYGON (((0 0, 0 2, 2 2, 2 0, 0 0)), ((10 0, 10 4, 14 4, 14 0, 10 0)))"
HOLED = "POLYGON((0 0,0 10,10 10,10 0,0 0),(6 1,9 1,9 9,6 9,6 1))"


def test_parsing(spark):
    texts = [SQUARE, TWO, HOLED, "POINT (1 1)", "polygon ((1 2 3, 0 0, 1 0, 1 1))", "POLYGON ((0 0, 1 1))", None,
             "POLYGON EMPTY", "POLYGON ((a b, 0 0, 1 0, 1 1.5e1))"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, w string")
    shapes = values(df.orderBy("i").select(F.expr(W.polygons("w")).alias("p")), "p")
    sizes = [[[len(r) for r in rings] for rings in s or []] or None for s in shapes]
    assert sizes == [[[5]], [[5], [5]], [[5, 5]], None, [[3]], None, None, None, [[3]]]
    handed = df.orderBy("i").select(*[c.alias(n) for c, n in zip(V.rings_of(W.polygons("w")), "xynm")])
    arrays = [[[len(r) for r in rings] for rings in V.assembled(*row)] or None for row in values(handed, *"xynm")]
    assert arrays == sizes


def test_parsing_odd_texts(spark):
    texts = ["MULTIPOLYGON(((0 0,0 3,3 0,0 0),(1 1,1 2,2 1,1 1)) , ((5 5,5 6,6 5,5 5)))", "POLYGON((1_0 0,0 1,1 1,2 2))",
             "POLYGON ( ( 0 0 , 0 1 , 1 1 ) )", "POLYGON((0 0,0 1,1 1", "POLYGON(())", "", "((0 0,1 1,2 2))"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, w string")
    shapes = values(df.orderBy("i").select(F.expr(W.polygons("w")).alias("p")), "p")
    assert [[[len(r) for r in part] for part in s] for s in shapes] == [[[4, 4], [4]], [[3]], [[3]], [], [], [], []]


def parsed(wkt):
    """The shape of a well-formed text."""
    parts = wkt[wkt.index("(") :].removeprefix("(").removesuffix(")")
    parts = parts.split(")), ((") if wkt.startswith("MULTI") else [parts]
    rings = [[r.strip("() ") for r in p.split("),(")] for p in parts]
    return [[np.array([p.split() for p in r.split(",")], float) for r in part] for part in rings]


def test_bounds_and_rectangles(spark):
    df = spark.createDataFrame([(1, SQUARE), (2, TWO), (3, "POINT (1 1)"), (4, CUP), (5, HOLED)], "i int, w string")
    assert sorted(values(G.with_bounds(df, "w"), "i", *G.BOX)) == [
        (1, 0, 0, 10, 10), (2, 0, 0, 14, 4), (4, 0, 0, 10, 10), (5, 0, 0, 10, 10),
    ]
    flags = df.orderBy("i").selectExpr(f"{W.is_rectangle('w')} AS r", f"{W.is_polygon('w')} AS p")
    assert values(flags, "r", "p") == [(True, True), (True, True), (False, False), (False, True), (True, True)]


def centre(wkt, *extent):
    point = V.visible_centroid(parsed(wkt), extent)
    return None if point is None else tuple(round(float(c), 9) for c in point)


def test_clipped_centroids():
    assert centre(SQUARE, -5, -5, 5, 5) == (2.5, 2.5)
    assert centre(SQUARE, 20, 20, 30, 30) is None
    assert centre(SQUARE, 10, 0, 20, 10) is None  # touching only: no area
    triangle = "POLYGON ((0 0, 0 9, 9 0, 0 0))"
    assert centre(triangle, 0, 0, 100, 100) == (3.0, 3.0)
    ring = V.clip_ring(np.array([[0, 0], [0, 9], [9, 0], [0, 0]], float), (1, 1, 5, 5))
    assert V.area_and_centroid(ring)[0] == pytest.approx(15.5)


def test_marker_is_moved_into_a_concave_shape():
    point = V.visible_centroid(parsed(CUP), (0, 0, 10, 10))
    ring = parsed(CUP)[0][0]
    assert not V.contains(ring, V.area_and_centroid(ring)[1])
    assert V.contains(ring, point)


def test_several_parts():
    # The mean of both parts lies in neither; the larger part wins.
    assert centre(TWO, -1, -1, 20, 20) == (12.0, 2.0)
    assert centre(TWO, -1, -1, 5, 5) == (1.0, 1.0)
    equal = "MULTIPOLYGON (((0 0, 0 2, 2 2, 2 0, 0 0)), ((8 0, 8 2, 10 2, 10 0, 8 0)))"
    assert centre(equal, -1, -1, 20, 20) == (9.0, 1.0)  # of equal parts, the later one


def test_inner_point_falls_back_to_the_longest_edge():
    flat = np.array([[0, 0], [10, 0], [0, 0]], float)
    assert tuple(V.inner_point(flat, np.array([50.0, 50.0]))) == (5.0, 0.0)


def test_surface_centroid_subtracts_holes():
    hole, whole = 24.0, 100.0
    expected = (whole * 5 - hole * 7.5) / (whole - hole)
    assert tuple(V.whole_centroid(parsed(HOLED))) == pytest.approx((expected, 5.0))
    assert V.whole_centroid([]) is None


def _brute(a, v):
    return {
        (i, j)
        for i, (ax, ay, aX, aY) in enumerate(a)
        for j, (vx, vy, vX, vY) in enumerate(v)
        if ax <= vX and aX >= vx and ay <= vY and aY >= vy
    }


_edge = st.one_of(
    st.integers(-40, 40).map(float), st.floats(-1e3, 1e3), st.sampled_from([0.0, 1e7, -6.5e7, 3e8, 1e17, -1e17, 0.015625])
)
_box = st.tuples(_edge, _edge, _edge, _edge).map(
    lambda b: (min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]), max(b[1], b[3]))
)


@settings(max_examples=12, deadline=None)
@given(st.lists(_box, min_size=1, max_size=40), st.lists(_box, min_size=1, max_size=20))
def test_box_join_equals_brute_force(spark, a, v):
    ddl = "k int, min_x double, min_y double, max_x double, max_y double"
    left = spark.createDataFrame([(i, *b) for i, b in enumerate(a)], ddl)
    right = spark.createDataFrame([(i, *b) for i, b in enumerate(v)], ddl.replace("k int", "w int"))
    got = values(G.overlapping(left, right), "k", "w")
    assert len(got) == len(set(got))
    assert set(got) == _brute(a, v)


def test_box_join_is_an_equi_join(supplied):
    boxes = G.with_bounds(supplied.location, "geometry_wkt").select("location_id", *G.BOX)
    plan = plan_of(G.overlapping(boxes, supplied.viewport))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_box_join_meets_few_candidates(spark):
    """20 000 boxes of 500 m and 400 of up to 2 km, spread over 1 000 km."""
    def spread(n, name, side):
        low = [f"rand({seed}) * 1e6 AS min_{axis}" for axis, seed in zip("xy", (n, n + 1))]
        return spark.range(n).selectExpr(f"id AS {name}", *low).selectExpr(
            "*", f"min_x + {side} AS max_x", f"min_y + {side} AS max_y"
        ).cache()

    left, right = spread(20_000, "k", 500.0), spread(400, "w", 2_000.0)
    met = G.meeting(left, right, "a_", "v_").groupBy("_kind", "_level", "_cx", "_cy").count()
    candidates, fullest = met.selectExpr("sum(count)", "max(count)").first()
    results = G.overlapping(left, right).count()
    assert 0 < results <= candidates < 10 * results + 20_400 and fullest < 60


@pytest.fixture(scope="module")
def marked(make):
    areas = make.table("area", [
        area(1, "1", "inside", 1, 2, wkt_polygon=SQUARE, centroid_x=4.0, centroid_y=6.0, observation_count=1500),
        area(2, "2", "across", 1, 2, wkt_polygon="POLYGON ((15 0, 15 10, 35 10, 35 0, 15 0))", centroid_x=25.0, centroid_y=5.0),
        area(3, "3", "touching", 1, 2, wkt_polygon="POLYGON ((20 0, 20 9, 30 9, 20 0))"),
        area(4, "4", "outside", 1, 2, wkt_polygon="POLYGON ((90 90, 90 99, 99 99, 90 90))"),
        area(5, "5", "no shape", 1, 2),
    ])
    views = make.table("viewport", [{"viewport_id": 1, "min_x": -1.0, "min_y": -1.0, "max_x": 20.0, "max_y": 20.0}])
    return areas, views


def test_viewport_markers(marked):
    got = values(G.viewport_markers(*marked), "area_id", "fully_visible", "marker_x", "marker_y")
    assert sorted(got) == [(1, True, 4.0, 6.0), (2, False, 17.5, 5.0), (3, False, 22.5, 4.5)]


def test_area_features(marked):
    rows = values(G.area_features(*marked), "area_id", "kind", "feature")
    features = {(a, k): json.loads(f) for a, k, f in rows}
    assert len(rows) == 6
    assert features[(1, "marker")]["properties"] == {
        "id": 1, "name": "inside", "areaTypeId": 1, "observationCount": 1500, "fid": "1", "label": "1.5K"
    }
    assert features[(1, "outline")]["geometry"]["coordinates"][0][1] == [0, 10]


def test_other_features(make):
    polygons = make.frame("location_id bigint, locality string, wkt_polygon string, observation_count bigint", [
        {"location_id": 1, "wkt_polygon": TWO, "observation_count": 0}, {"location_id": 2, "wkt_polygon": "POINT (1 1)"},
    ])
    (feature,) = [json.loads(f) for f in values(G.polygon_features(polygons), "feature")]
    assert feature["geometry"]["type"] == "MultiPolygon" and len(feature["geometry"]["coordinates"]) == 2
    assert feature["properties"]["name"] == "Location 1" and feature["properties"]["observationCountDisplay"] == ""
    located = make.frame("location_id bigint, latitude double, longitude double, observation_count bigint", [
        {"location_id": 1, "latitude": 59.5, "longitude": 10.0, "observation_count": 1200},
        {"location_id": 2, "latitude": float("nan"), "longitude": 1.0, "observation_count": 1},
    ])
    assert values(G.location_features(located), "feature") == [
        '{"type":"Feature","id":1,"geometry":{"type":"Point","coordinates":[10,59.5]},"properties":{"id":1,'
        '"name":"Location 1","observationCount":1200,"observationCountDisplay":"1.2K","isPolygon":false}}'
    ]
    assert G.overlay_features(make.table("area", [area(1, "1", "a", 1, 1, wkt_polygon=SQUARE)]), ()).count() == 0


def test_location_polygons_choose_the_top_before_the_shape(make):
    shapes = {1: "POINT (1 1)", 2: SQUARE, 3: CUP, 4: TWO, 5: "POLYGON ((0 0, 0 5, 5 5, 0 0))"}
    tables = make.tables(
        observation=[observation(10 * p + k, p) for p in shapes for k in range(7 - p)] + [observation(999, 77)] * 9,
        location=[location(p, geometry_wkt=w, east=5, north=5) for p, w in shapes.items()],
    )
    assert values(G.location_polygons(tables), "location_id", "observation_count") == [(3, 4), (5, 2)]
    assert values(G.location_polygons(tables, max_results=4), "location_id") == [3]
    assert values(G.requested_polygons(tables, ObservationFilter(max_results=4)), "location_id") == [3]
    far = ObservationFilter(envelope=Envelope(5.5, 0, 20, 20))
    assert values(G.location_polygons(tables, far), "location_id") == [3]
    assert [G.polygon_limit(n) for n in (0, -1, 10, 9_999)] == [2_000, 2_000, 10, 5_000]
