"""Observation counts per location (O-54) and their compact JSON form (O-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.functions.scalars import number_text, or_zero
from sightlines.operators.filters import (
    ObservationFilter,
    apply_filters,
    chosen_locations,
    inside_envelope,
)
from sightlines.sources.tables import OccurrenceTables


def count_by_location(observations: DataFrame) -> DataFrame:
    """Observations per location id; the partial count runs before the shuffle."""
    return (
        observations.where("location_id IS NOT NULL")
        .groupBy("location_id")
        .agg(F.count("*").alias("observation_count"))
    )


def location_limit(max_results: int) -> int:
    """O-64c: an out-of-range request falls back to the default (T-15)."""
    return max_results if 0 < max_results <= codes.MAX_LOCATIONS else codes.DEFAULT_LOCATIONS


def chosen_places(tables: OccurrenceTables, f: ObservationFilter) -> DataFrame:
    """The location rows a request allows: area and envelope filters say nothing about an
    observation but where it lies, so they are answered here and not per observation."""
    places = tables.location
    if f.envelope is not None:
        places = inside_envelope(places, f.envelope)
    if f.has_geography:
        places = places.join(chosen_locations(tables, f), "location_id", "left_semi")
    return places


def requested_locations(tables: OccurrenceTables, f: ObservationFilter = ObservationFilter()) -> DataFrame:
    """O-54 under the request's rule for the number of results."""
    return locations(tables, f, location_limit(f.max_results))


def locations(
    tables: OccurrenceTables, f: ObservationFilter = ObservationFilter(), max_results: int | None = None
) -> DataFrame:
    """Locations by number of matching observations: those with most, or all without ``max_results``.

    Counting comes before any join on the location, so that joins move one row per
    location and never an observation. Ties are broken by location id (T-09).
    """
    counts = count_by_location(apply_filters(tables.observation, tables, f.anywhere()))
    places = chosen_places(tables, f)
    ranked = (
        counts.join(places.select("location_id", "latitude", "longitude"), "location_id")
        .selectExpr(
            "location_id",
            f"{or_zero('latitude')} AS latitude",
            f"{or_zero('longitude')} AS longitude",
            "observation_count",
        )
        .orderBy(F.desc("observation_count"), "location_id")
    )
    return ranked if max_results is None else ranked.limit(max_results)


LOCATION_LINE = (
    f"concat('[', location_id, ',', {number_text('longitude')}, ',', {number_text('latitude')}, ',', "
    "observation_count, ']')"
)


def location_lines(located: DataFrame) -> DataFrame:
    """O-05, one JSON array ``[id,lon,lat,count]`` per row."""
    return located.selectExpr("location_id", f"{LOCATION_LINE} AS line")


def location_document(tables: OccurrenceTables, f: ObservationFilter = ObservationFilter()) -> DataFrame:
    """O-05 as one document with the request's EPSG code, for the rows of a request, which are at most 100 000;
    ``sinks.write_location_document`` writes any number of them as one file."""
    located = requested_locations(tables, f)
    lines = f"sort_array(collect_list(struct(-observation_count AS rank, location_id, {LOCATION_LINE} AS line)))"
    return located.agg(
        F.expr(f"""concat('{{"epsg":{int(f.epsg)},"locations":[', array_join({lines}.line, ','), ']}}')""").alias(
            "document"
        )
    )
