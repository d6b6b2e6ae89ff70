"""Co-located tables (O-51, O-64m, O-43): buckets of observation ids, so that rows of one observation meet without a shuffle.

The observations and the covering pair of each, its institution and municipality, are stored in the same number of buckets
of their id, sorted by it. A join of the two reads bucket by bucket and merges; only what else a list shows is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlines.operators.observations import covering_pairs
from sightlines.sources.tables import OccurrenceTables


@dataclass(frozen=True)
class Layout:
    """Tables in equal buckets of ``observation_id``."""

    observation: DataFrame
    covering: DataFrame


def write_bucketed(rows: DataFrame, table: str, path: str, buckets: int, key: str = "observation_id") -> DataFrame:
    """Store rows as a table of the session's catalog with its files at ``path``, one for each bucket, sorted by the key.

    A bucket is a hash of unique ids, so none is large because one value is frequent.
    """
    ordered = rows.repartition(buckets, F.col(key))
    ordered.write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return rows.sparkSession.table(table)


def write_layout(tables: OccurrenceTables, name: str, path: str, buckets: int) -> Layout:
    """Store both tables as ``<name>_observation`` and ``<name>_covering`` below ``path``.

    Choose buckets of a few million observations: 2 000 of them for 1e10.
    """
    stored = {
        part: write_bucketed(rows, f"{name}_{part}", f"{path.rstrip('/')}/{part}", buckets)
        for part, rows in (("observation", tables.observation), ("covering", covering_pairs(tables)))
    }
    return Layout(**stored)
