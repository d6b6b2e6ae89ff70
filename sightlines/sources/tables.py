"""Lazy access to the tables of the occurrence schema."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from sightlines import schema

if TYPE_CHECKING:
    from sightlines.operators.bitmaps import Bitmaps
    from sightlines.operators.cube import Cube
    from sightlines.operators.layouts import Layout
    from sightlines.operators.text_index import TextIndex


class OccurrenceTables:
    """One DataFrame per occurrence table, opened on first use (O-01).

    ``entity_index`` may be a stored table. When it is not, it is derived from
    the observation, location and organisation tables as part of each plan.
    """

    def __init__(
        self, spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]], stores: Mapping[str, object] | None = None
    ):
        self.spark = spark
        self._stores = dict(stores or {})
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> OccurrenceTables:
        """Tables stored as ``<root>/<table>``, read with their explicit schema."""

        def loader(name: str) -> Callable[[], DataFrame]:
            return lambda: spark.read.schema(schema.OCCURRENCE[name]).parquet(os.path.join(root, name))

        names = [n for n in schema.OCCURRENCE if n != "entity_index"]
        return cls(spark, {n: loader(n) for n in names})

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> OccurrenceTables:
        return cls(spark, {n: (lambda df=df: df) for n, df in frames.items()})

    def with_table(self, name: str, df: DataFrame) -> OccurrenceTables:
        """A copy in which ``name`` is ``df``."""
        return OccurrenceTables(self.spark, {**self._loaders, name: lambda: df}, self._stores)

    def with_stored_index(self, path: str) -> OccurrenceTables:
        """A copy that reads the entity index from ``path`` instead of deriving it."""
        return self.with_table(
            "entity_index", self.spark.read.schema(schema.OCCURRENCE["entity_index"]).parquet(path)
        )

    def with_text_index(self, path: str) -> OccurrenceTables:
        """A copy whose contains-searches go through the trigram index at ``path``."""
        from sightlines.operators.text_index import TextIndex

        return self._with_store("text_index", TextIndex(self.spark, path))

    def with_z_ordered_locations(self, path: str) -> OccurrenceTables:
        """A copy that reads its locations from ``path``, where they are stored in Z-order."""
        read = self.spark.read.schema(schema.OCCURRENCE["location"] + ", zkey bigint").parquet(path)
        return self.with_table("location", read)

    def with_layout(self, layout: Layout) -> OccurrenceTables:
        """A copy that reads observations and the institution and municipality of each from tables in equal buckets."""
        return self.with_table("observation", layout.observation)._with_store("covering", layout.covering)

    @property
    def covering(self) -> DataFrame | None:
        """(observation_id, institution, municipality_id), where stored."""
        return self._stores.get("covering")

    def with_bitmaps(self, path: str) -> OccurrenceTables:
        """A copy that answers filters and counts from the facet bitmaps at ``path`` where these can."""
        from sightlines.operators.bitmaps import Bitmaps

        return self._with_store("bitmaps", Bitmaps(self.spark, path))

    def with_cube(self, path: str) -> OccurrenceTables:
        """A copy that takes area counts from the stored cube at ``path`` where it can."""
        from sightlines.operators.cube import Cube

        return self._with_store("cube", Cube(self.spark, path))

    def _with_store(self, name: str, store: object) -> OccurrenceTables:
        return OccurrenceTables(self.spark, self._loaders, {**self._stores, name: store})

    @property
    def text_index(self) -> TextIndex | None:
        return self._stores.get("text_index")

    @property
    def cube(self) -> Cube | None:
        return self._stores.get("cube")

    @property
    def bitmaps(self) -> Bitmaps | None:
        return self._stores.get("bitmaps")

    @property
    def has_stored_index(self) -> bool:
        return "entity_index" in self._loaders

    @property
    def entity_index(self) -> DataFrame:
        """Index keys: (observation_id, entity_type_id, entity_id)."""
        if self.has_stored_index:
            return self._open("entity_index")
        from sightlines.operators.index import index_all

        return self._frames.setdefault("_derived_index", index_all(self))

    @property
    def enriched_index(self) -> DataFrame:
        """Index keys plus the seven filter columns."""
        if self.has_stored_index:
            return self._open("entity_index")
        from sightlines.operators.index import index_enriched

        return self._frames.setdefault("_derived_enriched_index", index_enriched(self))

    def _open(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._loaders:
            raise AttributeError(f"no table {name!r}")
        return self._open(name)
