"""Polygon queries, viewport markers and GeoJSON features (O-53, O-64n .. O-64r)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.functions import wkt as W
from sightlines.functions.scalars import abbreviated, any_of, or_zero
from sightlines.functions.visible import rings_of, surface_centroid, visible_point
from sightlines.operators.filters import ObservationFilter, apply_filters
from sightlines.operators.locations import chosen_places, count_by_location
from sightlines.sources.tables import OccurrenceTables

BOX = ("min_x", "min_y", "max_x", "max_y")

# Grid levels of the box join: cells of side 4^level; one cell for everything on top.
_FINEST, _COARSEST, _TOP = -3, 13, 14
_FURTHEST = "1e15"


def _with_parsed(df: DataFrame, wkt: str) -> DataFrame:
    """The parsed shape as ``_parsed``; rows that hold no polygon are dropped."""
    return df.selectExpr("*", W.when_filled(W.polygons(wkt), "_parsed"))


def with_bounds(df: DataFrame, wkt: str) -> DataFrame:
    """O-64o: the bounding box of a WKT column; rows that hold no polygon are dropped."""
    pointed = df.selectExpr("*", W.when_filled(W.points(W.polygons(wkt)), "_points"))
    return pointed.selectExpr(*df.columns, f"inline(array({W.bounds('_points')}))")


# --- box overlap join --------------------------------------------------------


def _cell(value: str, level: str = "_level") -> str:
    clamped = f"greatest(least({value}, {_FURTHEST}), -{_FURTHEST})"
    return f"CAST(IF({level} = {_TOP}, 0, floor({clamped} / pow(4D, {level}))) AS BIGINT)"


def _own_level(boxes: DataFrame) -> DataFrame:
    """Boxes with ``_own``: the finest level at which a box touches at most two cells per axis."""
    size = "greatest(max_x - min_x, max_y - min_y)"
    fitting = f"CAST(ceil(log(4D, greatest({size}, {4.0**_FINEST}D))) AS INT)"
    return boxes.selectExpr("*", f"IF({size} > {4.0**_COARSEST}D, {_TOP}, greatest({fitting}, {_FINEST})) AS _own")


def _on_grid(boxes: DataFrame, other: DataFrame, prefix: str, coarser_than_own: bool) -> DataFrame:
    """Each box in the cells it touches, in two kinds of grids.

    Grids of one kind hold the boxes of this side at their own level, those of the other kind copies at the levels at
    which the other side has boxes of its own: strictly coarser ones if ``coarser_than_own``, else the own level too.
    So a copy never meets a copy.
    """
    kept = [f"{c} AS {prefix}{c}" if c in BOX else c for c in boxes.columns if c != "_own"]
    columns = [f"{prefix}{c}" if c in BOX else c for c in boxes.columns if c != "_own"]
    own_kind, first = (0, "_own + 1") if coarser_than_own else (1, "_own")
    levels = other.selectExpr("_own AS _level").distinct()
    named = boxes.selectExpr(*kept, "_own")
    copies = named.where(f"{first} <= {_TOP}").selectExpr(
        *columns, f"{1 - own_kind} AS _kind", f"explode(sequence({first}, {_TOP})) AS _level"
    ).join(levels, "_level", "left_semi")
    own = named.selectExpr(*columns, f"{own_kind} AS _kind", "_own AS _level")

    def span(axis: str) -> str:
        low, high = _cell(f"{prefix}min_{axis}"), _cell(f"{prefix}max_{axis}")
        return f"explode(sequence({low}, {high})) AS _c{axis}"

    at = (*columns, "_kind", "_level")
    return own.unionByName(copies).selectExpr(*at, span("x")).selectExpr(*at, "_cx", span("y"))


def meeting(left: DataFrame, right: DataFrame, left_prefix: str, right_prefix: str) -> DataFrame:
    """Candidate pairs of ``overlapping``: boxes that share a cell at the coarser of their two levels."""
    left, right = _own_level(left), _own_level(right)
    cells = ["_kind", "_level", "_cx", "_cy"]
    return _on_grid(left, right, left_prefix, True).join(_on_grid(right, left, right_prefix, False), cells)


def overlapping(left: DataFrame, right: DataFrame, left_prefix: str = "a_", right_prefix: str = "v_") -> DataFrame:
    """O-53: pairs whose boxes overlap or touch, as an equi-join on grid cells.

    The larger box of a pair stands in the grid of its own level, where it touches at most four cells and fills a good
    part of them; the smaller one is copied to that level. The pair is kept in the cell that holds the lower left
    corner of its intersection, hence exactly once. Box columns come back with a prefix; carry ids through this join
    and fetch wide columns by id afterwards.
    """
    a, v = left_prefix, right_prefix

    def met(axis: str) -> str:
        corner = _cell(f"greatest({a}min_{axis}, {v}min_{axis})")
        return (
            f"{a}min_{axis} <= {v}max_{axis} AND {a}max_{axis} >= {v}min_{axis} AND _c{axis} = {corner}"
        )

    return meeting(left, right, a, v).where(f"{met('x')} AND {met('y')}").drop("_kind", "_level", "_cx", "_cy")


# --- queries -----------------------------------------------------------------


def polygon_limit(max_results: int) -> int:
    """O-64c: clamped to the maximum; none given means the default (T-15)."""
    return min(max_results, codes.MAX_POLYGONS) if max_results > 0 else codes.DEFAULT_POLYGONS


def requested_polygons(tables: OccurrenceTables, f: ObservationFilter = ObservationFilter()) -> DataFrame:
    """O-64n under the request's rule for the number of results."""
    return location_polygons(tables, f, polygon_limit(f.max_results))


def location_polygons(
    tables: OccurrenceTables, f: ObservationFilter = ObservationFilter(), max_results: int | None = None
) -> DataFrame:
    """O-64n: polygon shapes of the locations with most observations, of all locations without ``max_results``.

    The top locations are chosen before shapes are looked at, so the result may be shorter than the limit (T-10).
    """
    counts = count_by_location(apply_filters(tables.observation, tables, f.anywhere()))
    if f.has_geography or f.envelope is not None:
        counts = counts.join(chosen_places(tables, f).select("location_id"), "location_id", "left_semi")
    if max_results is not None:
        counts = counts.orderBy(F.desc("observation_count"), "location_id").limit(max_results)
    shaped = tables.location.select("location_id", "locality", "geometry_wkt").where(
        f"{W.is_polygon('geometry_wkt')} AND NOT {W.is_rectangle('geometry_wkt')}"
    )
    found = shaped.join(counts, "location_id")
    if f.envelope is not None:
        e = f.envelope
        found = with_bounds(found, "geometry_wkt").where(
            f"max_x >= {float(e.min_x)}D AND min_x <= {float(e.max_x)}D "
            f"AND max_y >= {float(e.min_y)}D AND min_y <= {float(e.max_y)}D"
        )
    found = found.selectExpr(
        "location_id", "locality", "geometry_wkt AS wkt_polygon", "observation_count"
    ).orderBy(F.desc("observation_count"), "location_id")
    return found if max_results is None else found.limit(max_results)


def with_centroids(areas: DataFrame) -> DataFrame:
    """O-64r: centroid of each area's surface, null without a polygon."""
    bare = areas.drop("centroid_x", "centroid_y")
    parsed = areas.selectExpr(*bare.columns, f"{W.polygons('wkt_polygon')} AS _parsed")
    pointed = parsed.withColumn("_point", surface_centroid(*rings_of("_parsed"))).drop("_parsed")
    return pointed.selectExpr(*bare.columns, "_point.x AS centroid_x", "_point.y AS centroid_y")


def viewport_markers(areas: DataFrame, viewports: DataFrame) -> DataFrame:
    """O-64p: one marker per area and viewport that overlap.

    ``areas`` carry ``wkt_polygon`` and a stored centroid. A fully visible area is
    marked at its stored centroid; only the others reach the clipping function.
    """
    boxes = with_bounds(areas.select("area_id", "wkt_polygon"), "wkt_polygon").drop("wkt_polygon")
    inside = (
        "a_min_x >= v_min_x AND a_min_y >= v_min_y AND a_max_x <= v_max_x AND a_max_y <= v_max_y AS fully_visible"
    )
    pairs = overlapping(boxes, viewports).selectExpr("*", inside)
    pairs = pairs.drop("a_min_x", "a_min_y", "a_max_x", "a_max_y").join(areas, "area_id")
    columns = [c for c in pairs.columns if not c.startswith("v_") and c != "fully_visible"]
    no_centroid = "centroid_x IS NULL OR centroid_y IS NULL"
    parsed = pairs.selectExpr(
        "*", f"IF(fully_visible AND NOT ({no_centroid}), NULL, {W.polygons('wkt_polygon')}) AS _parsed"
    )
    # the union keeps rows without anything to clip away from the Arrow function
    whole = parsed.where("fully_visible").selectExpr("*", "CAST(NULL AS STRUCT<x: DOUBLE, y: DOUBLE>) AS _clipped")
    cut = parsed.where("NOT fully_visible").withColumn(
        "_clipped", visible_point(*rings_of("_parsed"), *[f"v_{c}" for c in BOX])
    )
    return whole.unionByName(cut).selectExpr(
        *columns,
        "fully_visible",
        *[
            f"coalesce(_clipped.{axis}, IF({no_centroid}, {W.first_ring_mean('_parsed', axis)}, centroid_{axis})) "
            f"AS marker_{axis}"
            for axis in ("x", "y")
        ],
    )


# --- features ----------------------------------------------------------------


def _feature(geometry: str, properties: dict[str, str], feature_id: str | None = None) -> str:
    """Text of a GeoJSON feature; ``properties`` maps names to expressions."""
    head = "'{\"type\":\"Feature\",'" if feature_id is None else f"'{{\"type\":\"Feature\",\"id\":', {feature_id}, ','"
    fields = ", ".join(f"{expression} AS {name}" for name, expression in properties.items())
    return (
        f"concat({head}, '\"geometry\":', {geometry}, ',\"properties\":', to_json(struct({fields})), '}}')"
    )


def _point_geometry(x: str, y: str) -> str:
    return f"concat('{{\"type\":\"Point\",\"coordinates\":', {W.point_json(x, y)}, '}}')"


def _shown(count: str) -> str:
    return f"IF({count} > 0, {abbreviated(count)}, '')"


def location_features(located: DataFrame) -> DataFrame:
    """O-64q: point features of locations, one per row; NaN coordinates are dropped."""
    properties = {
        "id": "location_id",
        "name": "concat('Location ', location_id)",
        "observationCount": "observation_count",
        "observationCountDisplay": _shown("observation_count"),
        "isPolygon": "FALSE",
    }
    feature = _feature(_point_geometry("longitude", "latitude"), properties, "location_id")
    usable = located.where("NOT isnan(longitude) AND NOT isnan(latitude)")
    return usable.selectExpr("location_id", f"{feature} AS feature")


def polygon_features(polygons: DataFrame) -> DataFrame:
    """O-64q: outline features of location polygons; unparsable shapes are dropped."""
    count = or_zero("observation_count")
    properties = {
        "id": "location_id",
        "name": "coalesce(locality, concat('Location ', location_id))",
        "observationCount": count,
        "observationCountDisplay": _shown(count),
        "isPolygon": "TRUE",
    }
    feature = _feature(W.geometry_json("wkt_polygon", "_parsed"), properties, "location_id")
    return _with_parsed(polygons, "wkt_polygon").selectExpr("location_id", f"{feature} AS feature")


def overlay_features(areas: DataFrame, fids: tuple[str, ...]) -> DataFrame:
    """O-64q: outlines of chosen areas."""
    chosen = areas.where(any_of("fid", fids))
    properties = {"id": "area_id", "name": "name", "fid": "fid"}
    feature = _feature(W.geometry_json("wkt_polygon", "_parsed"), properties)
    return _with_parsed(chosen, "wkt_polygon").selectExpr("area_id", f"{feature} AS feature")


def area_features(areas: DataFrame, viewports: DataFrame) -> DataFrame:
    """O-64q: per viewport, the outline of each overlapping area and its count marker."""
    marked = _with_parsed(viewport_markers(areas, viewports), "wkt_polygon")
    named = {"id": "area_id", "name": "name", "areaTypeId": "area_type_id"}
    outline = _feature(W.geometry_json("wkt_polygon", "_parsed"), {**named, "fid": "fid"})
    count = or_zero("observation_count")
    marker = _feature(
        _point_geometry("marker_x", "marker_y"),
        {**named, "observationCount": count, "fid": "fid", "label": abbreviated(count)},
    )
    return marked.selectExpr(
        "viewport_id",
        "area_id",
        f"inline(array(struct('outline' AS kind, {outline} AS feature), struct('marker' AS kind, {marker} AS feature)))",
    )
