"""Stratified samples for test extracts (O-63).

``row_number() <= k`` is cut per partition before the shuffle (window group
limit), so a stratum that holds most rows sends only ``k`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightlines.sources.tables import OccurrenceTables


def first_per_stratum(df: DataFrame, strata: tuple[str, ...], order_by: str, k: int) -> DataFrame:
    """The first ``k`` rows of each stratum; a null is a stratum of its own."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order_by))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def sample_taxa(tables: OccurrenceTables, per_group: int = 2) -> DataFrame:
    taxa = tables.taxon.where(~F.col("is_deleted"))
    return first_per_stratum(taxa, ("taxon_rank_id", "taxon_group_id", "exists_in_country"), "taxon_id", per_group)


def sample_observations(tables: OccurrenceTables, taxa_per_group: int = 2, per_group: int = 3) -> DataFrame:
    """Observations of the sampled taxa that have a location, a category and a taxon group."""
    taxa = sample_taxa(tables, taxa_per_group).select("taxon_id")
    known = tables.observation.where("location_id IS NOT NULL AND category_id IS NOT NULL AND taxon_group_id IS NOT NULL")
    of_taxa = known.join(taxa, "taxon_id", "left_semi")
    return first_per_stratum(of_taxa, ("category_id", "taxon_id", "taxon_group_id"), "observation_id", per_group)


def sample_locations(tables: OccurrenceTables, taxa_per_group: int = 2, per_group: int = 3) -> DataFrame:
    """The distinct locations of the sampled observations."""
    return sample_observations(tables, taxa_per_group, per_group).select("location_id").distinct()


def sampled_rows(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows of another table that belong to a sample."""
    return df.join(sample.select(key).distinct(), key, "left_semi")
