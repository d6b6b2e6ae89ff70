"""Locations in Z-order, so that an envelope reads few row groups (O-37, O-54, O-64n).

The bits of both coordinates are interleaved to one key, and the table is stored in its order: places that lie close
together are stored close together, whichever way an envelope extends. An envelope is taken apart into key ranges, the
quadrants that lie in it or at its edge; the ranges reach the scan, whose statistics rule row groups out. The exact test
of the coordinates stays behind it, so any number of ranges gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlines.operators.filters import Envelope

KEY = "zkey"
# Bits of a coordinate, and what is added before its bits are taken; others are moved to the nearest bound.
BITS, SHIFTED = 31, 1 << 30
# Ranges of an envelope, at most.
MOST_RANGES = 64


def _number(column: str) -> str:
    return f"CAST(least(greatest(CAST({column} AS BIGINT) + {SHIFTED}, 0L), {(1 << BITS) - 1}L) AS BIGINT)"


def z_key(x: str, y: str) -> str:
    """The interleaved bits of two integer columns as an SQL expression; null where one is null."""
    spread = "aggregate(sequence(0, {bits}), 0L, (a, i) -> a | shiftleft(CAST(getbit({n}, i) AS BIGINT), 2 * i + {at}))"
    parts = [spread.format(bits=BITS - 1, n=_number(c), at=at) for at, c in enumerate((x, y))]
    return f"IF({x} IS NULL OR {y} IS NULL, NULL, {parts[0]} | {parts[1]})"


def _moved(value: float) -> int:
    return min(max(int(value) + SHIFTED, 0), (1 << BITS) - 1)


def z_ranges(envelope: Envelope, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Inclusive key ranges that hold every key of an envelope, ascending and apart from each other.

    Quadrants at the edge are quartered, the largest first, while there are fewer than ``most``.
    """
    low = _moved(envelope.min_x), _moved(envelope.min_y)
    high = _moved(envelope.max_x), _moved(envelope.max_y)
    inside: list[tuple[int, int]] = []
    edge = [(0, 0, 0, BITS)]  # key, x, y and bits of a quadrant
    while edge:
        key, x, y, bits = edge.pop(0)
        if bits == 0 or len(inside) + len(edge) + 4 > most:
            inside.append((key, key + (1 << 2 * bits) - 1))
            continue
        half = 1 << (bits - 1)
        for quarter in range(4):
            left, bottom = x + half * (quarter & 1), y + half * (quarter >> 1)
            right, top = left + half - 1, bottom + half - 1
            if left > high[0] or right < low[0] or bottom > high[1] or top < low[1]:
                continue
            start = key + (quarter << 2 * (bits - 1))
            if left >= low[0] and right <= high[0] and bottom >= low[1] and top <= high[1]:
                inside.append((start, start + (1 << 2 * (bits - 1)) - 1))
            else:
                edge.append((start, left, bottom, bits - 1))
    merged: list[tuple[int, int]] = []
    for start, end in sorted(inside):
        if merged and start <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def range_condition(envelope: Envelope) -> str:
    """The key ranges of an envelope as an SQL condition, which becomes filters of the scan."""
    return " OR ".join(f"({KEY} >= {start}L AND {KEY} <= {end}L)" for start, end in z_ranges(envelope)) or "FALSE"


def write_z_ordered(location: DataFrame, path: str, mode: str = "error", files: int | None = None, rows: int | None = None) -> None:
    """Store locations with their key, in its order; ``rows`` bounds the rows of a file, which else follow from ``files``."""
    keyed = location.withColumn(KEY, F.expr(z_key("east", "north")))
    ordered = keyed.repartitionByRange(*([files] if files else []), KEY).sortWithinPartitions(KEY)
    ordered.write.mode(mode).option("maxRecordsPerFile", rows or 0).parquet(path)
