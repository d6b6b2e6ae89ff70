"""Scalar expressions (O-07 .. O-18, O-22).

Functions take and return expression texts, so that they nest and cost one call
to the JVM where they are used.
"""

from __future__ import annotations

import re

from sightlines import codes


def quoted(text: str) -> str:
    """A Python string as an SQL literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def or_zero(value: str) -> str:
    """O-07: null counts and coordinates read as zero."""
    return f"coalesce({value}, 0)"


def entity_id(fid: str) -> str:
    """O-10: area fid to integer id; null when it is not a number."""
    return f"try_cast(replace({fid}, '_', '') AS INT)"


def restricted_entity_id(fid: str) -> str:
    """O-11: restricted-area fid to integer id."""
    return f"try_cast(replace({fid}, '{codes.RESTRICTED_FID_PREFIX}', '') AS INT)"


def area_entity_id(fid: str, area_type: str) -> str:
    """The id under which the index stores an area."""
    return f"IF({area_type} = {codes.RESTRICTED_AREA}, {restricted_entity_id(fid)}, {entity_id(fid)})"


_INTEGER = re.compile(r"\s*[+-]?[0-9]+\s*")


def parse_entity_ids(fids: tuple[str, ...], prefix: str = "_") -> list[int]:
    """The ids of a fid list of a request; entries that are no 32-bit number are dropped."""
    texts = (fid.replace(prefix, "") for fid in fids)
    numbers = (int(t) for t in texts if _INTEGER.fullmatch(t))
    return [n for n in numbers if -(2**31) <= n < 2**31]


def default_zoom_level(area_type: str, current: str) -> str:
    """O-13: counties show at zoom 1, municipalities at zoom 2, others keep theirs."""
    return f"CASE {area_type} WHEN {codes.COUNTY} THEN 1 WHEN {codes.MUNICIPALITY} THEN 2 ELSE {current} END"


def registration_status(not_recovered: str, absent: str) -> str:
    """O-14: status from the two tag flags; "not recovered" outranks "absent"."""
    return (
        f"CASE WHEN {not_recovered} THEN {codes.STATUS_NOT_RECOVERED} "
        f"WHEN {absent} THEN {codes.STATUS_ABSENT} ELSE {codes.STATUS_FOUND} END"
    )


def export_slug(name: str) -> str:
    """O-16: file-name form of an export name."""
    kept = f"regexp_replace(translate({name}, ' ', '-'), '[^\\\\p{{L}}\\\\p{{Nd}}_-]', '')"
    blank = f"{name} IS NULL OR regexp_replace({name}, '\\\\s', '') = '' OR {kept} = ''"
    return f"IF({blank}, '{codes.EXPORT_DEFAULT_NAME}', {kept})"


def abbreviated(count: str) -> str:
    """O-17: 1234 -> 1.2K. Ties round half up in decimal arithmetic."""

    def scaled(divisor: int, suffix: str) -> str:
        tenths = f"round(CAST({count} AS DECIMAL(20, 0)) / CAST({divisor} AS DECIMAL(10, 0)), 1)"
        text = f"CAST(CAST({tenths} AS DECIMAL(20, 1)) AS STRING)"
        return f"concat(regexp_replace({text}, '\\\\.0$', ''), '{suffix}')"

    return (
        f"CASE WHEN {count} >= 1000000 THEN {scaled(1_000_000, 'M')} "
        f"WHEN {count} >= 1000 THEN {scaled(1_000, 'K')} ELSE CAST({count} AS STRING) END"
    )


def category_rank(code: str) -> str:
    """O-18: position of a category code in the display order; unknown codes come last."""
    order = ", ".join(quoted(c) for c in codes.CATEGORY_ORDER)
    last = len(codes.CATEGORY_ORDER) + 1
    return f"coalesce(nullif(CAST(array_position(array({order}), {code}) AS INT), 0), {last})"


def zoom_bucket(zoom: str) -> str:
    """O-22: map zoom to result level: 3 points, 2 municipalities, 1 counties."""
    return f"CASE WHEN {zoom} >= 11 THEN 3 WHEN {zoom} >= 9 THEN 2 ELSE 1 END"


def number_text(value: str) -> str:
    """A double in invariant notation: shortest digits, no trailing ``.0``,
    exponents from 1E+15 up and from 1E-05 down."""
    shortest = f"CAST({value} AS STRING)"
    plain = f"CAST(try_cast({value} AS DECIMAL(38, 18)) AS STRING)"
    digits = f"regexp_replace(regexp_replace({plain}, '0+$', ''), '\\\\.$', '')"
    exponent = f"try_cast(regexp_extract({shortest}, 'E(-?\\\\d+)$', 1) AS INT)"
    mantissa = f"regexp_replace(regexp_replace({shortest}, 'E.*$', ''), '\\\\.0$', '')"
    scientific = f"concat({mantissa}, IF({exponent} < 0, 'E-', 'E+'), lpad(CAST(abs({exponent}) AS STRING), 2, '0'))"
    size = f"abs({value})"
    return (
        f"CASE WHEN isnan({value}) THEN {shortest} WHEN {size} = 0 THEN '0' "
        f"WHEN {size} >= 1e-5 AND {size} < 1e15 THEN {digits} "
        f"WHEN {exponent} IS NOT NULL THEN {scientific} ELSE {shortest} END"
    )


def contains_text(column: str, term: str) -> str:
    """Case-insensitive literal substring match (O-38: ``[``, ``%`` and ``_`` are plain characters)."""
    return f"contains(lower({column}), {quoted(term.lower())})"


def any_of(column: str, values: tuple | list) -> str:
    """Membership in a request list; false, not null, when the column is null."""
    if not values:
        return "FALSE"
    items = ", ".join(quoted(v) if isinstance(v, str) else str(int(v)) for v in values)
    return f"coalesce({column} IN ({items}), FALSE)"
