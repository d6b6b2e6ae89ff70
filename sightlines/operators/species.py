"""Species responses of two JSON shapes as one record type (O-64l)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlines import schema

SEARCH, BY_ID = "search", "by_id"


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _list(column: Column) -> Column:
    return F.coalesce(column, F.array())


def _from_search(doc: Column) -> Column:
    accepted = doc["acceptedScientificName"]

    def vernacular(v: Column) -> Column:
        return _struct(name=v["name"], language=v["nameLanguageIso"])

    return _struct(
        taxon_id=doc["taxonId"],
        scientific_name=accepted["name"],
        scientific_name_formatted=accepted["nameFormatted"],
        author=accepted["author"],
        rank=accepted["rank"],
        preferred_vernacular_names=F.transform(_list(doc["preferredVernacularNames"]), vernacular),
        vernacular_name_synonyms=F.transform(_list(doc["vernacularNameSynonyms"]), vernacular),
        scientific_name_synonyms=F.transform(
            _list(doc["scientificNameSynonyms"]),
            lambda s: _struct(name=s["name"], name_formatted=s["nameFormatted"], author=s["author"], rank=s["rank"]),
        ),
    )


def _from_id(doc: Column) -> Column:
    """The first accepted name leads; without one, only the id is known."""
    names = _list(doc["scientificNames"])
    accepted = F.get(F.filter(names, lambda s: s["taxonomicStatus"] == "Accepted"), F.lit(0))
    known = accepted.isNotNull()

    def if_known(column: Column) -> Column:
        return F.when(known, column).otherwise(F.array())

    def vernaculars(recommended: bool) -> Column:
        is_recommended = lambda v: F.coalesce(v["vernacularNameStatus"] == "Recommended", F.lit(False))
        chosen = F.filter(
            _list(doc["vernacularNames"]), lambda v: is_recommended(v) if recommended else ~is_recommended(v)
        )
        return if_known(
            F.transform(chosen, lambda v: _struct(name=v["vernacularName"], language=v["languageIsoCode"]))
        )

    synonyms = F.transform(
        F.filter(names, lambda s: s["taxonomicStatus"] == "Synonym"),
        lambda s: _struct(
            name=s["scientificNamePresentation"],
            name_formatted=s["scientificNamePresentationHtml"],
            author=s["scientificNameAuthorship"],
            rank=s["taxonRank"],
        ),
    )
    return _struct(
        taxon_id=doc["taxonId"],
        scientific_name=accepted["scientificNamePresentation"],
        scientific_name_formatted=accepted["scientificNamePresentationHtml"],
        author=accepted["scientificNameAuthorship"],
        rank=accepted["taxonRank"],
        preferred_vernacular_names=vernaculars(True),
        vernacular_name_synonyms=vernaculars(False),
        scientific_name_synonyms=if_known(synonyms),
    )


def species_records(responses: DataFrame) -> DataFrame:
    """(response_id, record fields) from rows of (response_id, shape, body)."""
    # Parsed in a projection of its own, so that each body is read once.
    parsed = responses.select(
        "response_id",
        F.when(F.col("shape") == SEARCH, F.from_json("body", schema.SPECIES_SEARCH_JSON)).alias("by_search"),
        F.when(F.col("shape") == BY_ID, F.from_json("body", schema.SPECIES_BY_ID_JSON)).alias("by_id"),
    )
    record = F.when(F.col("by_search").isNotNull(), _from_search(F.col("by_search"))).when(
        F.col("by_id").isNotNull(), _from_id(F.col("by_id"))
    )
    return parsed.select("response_id", record.alias("record")).select("response_id", "record.*")
