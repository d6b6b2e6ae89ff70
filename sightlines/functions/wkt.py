"""WKT polygons as Spark expressions (O-64o); no user-defined function needed.

A parsed geometry is polygons -> rings -> points: ``array<array<array<struct<x,y>>>>``.
Points with other than two numbers and rings with fewer than three points are
left out; text that is no polygon parses to an empty list, null to null. Functions
take and return expression texts.
"""

from __future__ import annotations

from sightlines.functions.scalars import number_text


def is_multi(wkt: str) -> str:
    return f"rlike({wkt}, '(?i)MULTIPOLYGON')"


def is_polygon(wkt: str) -> str:
    """The geometry type is Polygon or MultiPolygon."""
    return f"rlike({wkt}, '(?i)^\\\\s*(MULTI)?POLYGON')"


def _numbered_points(text: str) -> str:
    """Points of a comma-separated list; entries of other than two numbers are left out."""
    numbers = "filter(split(entry, '[ \\\\t\\\\r\\\\n]'), n -> n <> '')"
    read = f"transform(split({text}, ','), entry -> transform({numbers}, n -> try_cast(n AS DOUBLE)))"
    usable = f"filter({read}, xy -> size(xy) = 2 AND forall(xy, n -> n IS NOT NULL))"
    return f"transform({usable}, xy -> named_struct('x', xy[0], 'y', xy[1]))"


def polygons(wkt: str) -> str:
    """Rings are the innermost parenthesised lists, in text order; a part ends where two parentheses close at once."""
    innermost = f"regexp_extract_all({wkt}, '[(]([^()]*)([)]\\\\s*[)]?)', 0)"
    listed = f"IF(rlike({wkt}, '(?i)POLYGON\\\\s*[(]\\\\s*[(]'), {innermost}, IF({wkt} IS NULL, NULL, array()))"
    ring = _numbered_points("translate(token, '()', '')")
    tokens = f"transform({listed}, token -> named_struct('ring', {ring}, 'closes', rlike(token, '[)]\\\\s*[)]')))"
    # parts that are done, and the rings of the one that is open
    step = (
        "IF(token.closes, named_struct('done', concat(s.done, array(concat(s.open, array(token.ring)))),"
        " 'open', slice(s.open, 1, 0)), named_struct('done', s.done, 'open', concat(s.open, array(token.ring))))"
    )
    point = "STRUCT<x: DOUBLE, y: DOUBLE>"
    nothing = (
        f"named_struct('done', CAST(array() AS ARRAY<ARRAY<ARRAY<{point}>>>),"
        f" 'open', CAST(array() AS ARRAY<ARRAY<{point}>>))"
    )
    grouped = f"aggregate({tokens}, {nothing}, (s, token) -> {step}, s -> s.done)"
    filled = f"transform({grouped}, part -> filter(part, ring -> size(ring) >= 3))"
    return f"filter({filled}, part -> size(part) > 0)"


def when_filled(items: str, alias: str) -> str:
    """A list expression as one row, none when it is empty or null.

    As a generator it is evaluated once per row, and later predicates on the result
    stay above it instead of being copied into the scan together with the parsing.
    """
    return f"explode(filter(array({items}), items -> size(items) > 0)) AS {alias}"


def points(parsed: str) -> str:
    """All points of a parsed geometry, holes included."""
    return f"flatten(flatten({parsed}))"


def bounds(all_points: str) -> str:
    """struct<min_x, min_y, max_x, max_y> of a point list."""
    box = ", ".join(
        f"'{side}_{axis}', array_{side}(transform({all_points}, p -> p.{axis}))"
        for side in ("min", "max")
        for axis in ("x", "y")
    )
    return f"named_struct({box})"


def first_ring_mean(parsed: str, axis: str) -> str:
    """Mean of one coordinate over the vertices of the first ring."""
    ring = f"get(get({parsed}, 0), 0)"
    return f"aggregate({ring}, 0D, (total, p) -> total + p.{axis}) / size({ring})"


def is_rectangle(wkt: str) -> str:
    """Exactly five points in the first ring, as grid squares have: four commas
    between the second ``(`` and the next ``)``."""
    ring = f"regexp_extract({wkt}, '^[^(]*\\\\([^(]*\\\\(([^)]*)\\\\)', 1)"
    return f"regexp_count({ring}, ',') = 4"


def point_json(x: str, y: str) -> str:
    return f"concat('[', {number_text(x)}, ',', {number_text(y)}, ']')"


def _json_list(items: str) -> str:
    return f"concat('[', array_join({items}, ','), ']')"


def geometry_json(wkt: str, parsed: str) -> str:
    """GeoJSON geometry text of a parsed polygon or multipolygon."""
    ring_json = _json_list(f"transform(ring, p -> {point_json('p.x', 'p.y')})")
    rings_json = _json_list(f"transform(rings, ring -> {ring_json})")
    shapes = f"transform({parsed}, rings -> {rings_json})"
    several = f"concat('{{\"type\":\"MultiPolygon\",\"coordinates\":', {_json_list(shapes)}, '}}')"
    one = f"concat('{{\"type\":\"Polygon\",\"coordinates\":', {shapes}[0], '}}')"
    return f"IF({is_multi(wkt)}, {several}, {one})"
