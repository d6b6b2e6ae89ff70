"""Ranked taxon-name search (O-64f)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.functions.scalars import contains_text, quoted
from sightlines.operators.text_index import with_text
from sightlines.sources.tables import OccurrenceTables

EXACT, PREFIX, INSIDE = 1, 2, 3


def active_taxa(tables: OccurrenceTables) -> DataFrame:
    return tables.taxon.where("NOT is_deleted AND (cumulative_observation_count > 0 OR exists_in_country)")


def _names(tables: OccurrenceTables, term: str | None = None) -> DataFrame:
    """Undeleted scientific and popular names, of which all contain the term: (taxon_id, name)."""
    scientific, popular = (t.where("NOT is_deleted") for t in (tables.taxon_name, tables.taxon_popular_name))
    if term:
        scientific = with_text(scientific, tables, "taxon_name", "scientific_name", term)
        popular = with_text(popular, tables, "taxon_popular_name", "name", term)
    return scientific.selectExpr("taxon_id", "scientific_name AS name").unionByName(popular.select("taxon_id", "name"))


def _tests(name: str, term: str) -> tuple[str, str, str]:
    """Equal, starts with, contains; ignoring case, wildcards taken literally."""
    text, wanted = f"lower({name})", quoted(term)
    return f"{text} = {wanted}", f"startswith({text}, {wanted})", contains_text(name, term)


def match_level(name: str, term: str) -> str:
    exact, prefix, _ = _tests(name, term)
    return f"CASE WHEN {exact} THEN {EXACT} WHEN {prefix} THEN {PREFIX} ELSE {INSIDE} END"


def matching_taxa(tables: OccurrenceTables, name: str) -> DataFrame:
    """Active taxa with a matching name and their best level, in one pass over the names."""
    term = name.strip().lower()
    hits = _names(tables, term).groupBy("taxon_id").agg(F.expr(f"min({match_level('name', term)}) AS level"))
    return active_taxa(tables).join(hits, "taxon_id")


def taxon_search(tables: OccurrenceTables, name: str, max_count: int = codes.DEFAULT_TAXA) -> DataFrame:
    """The best ``max_count`` taxa, ordered by level and id (T-07); a blank name finds none."""
    if not 1 <= max_count <= codes.MAX_TAXA:
        raise ValueError(f"max_count must be between 1 and {codes.MAX_TAXA}")
    found = matching_taxa(tables, name)
    if not name.strip():
        found = found.where("FALSE")
    return (
        found.orderBy("level", "taxon_id")
        .limit(max_count)
        .select(
            "taxon_id", "external_taxon_id", "valid_scientific_name", "valid_scientific_name_authorship",
            "preferred_popular_name", "taxon_group_id", "taxon_rank_id", "cumulative_observation_count",
            "exists_in_country",
        )
    )


def taxon_union(tables: OccurrenceTables, name: str) -> DataFrame:
    """The same matches as a union of the three levels; every match, no limit."""
    term = name.strip().lower()
    names = _names(tables)
    exact, prefix, inside = (names.where(test).select("taxon_id") for test in _tests("name", term))
    ids = exact.union(prefix).union(inside).distinct()
    return active_taxa(tables).join(ids, "taxon_id", "left_semi")
