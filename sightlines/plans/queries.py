"""Named queries: (session, scale-factor folder) -> DataFrame.

Column names equal those of ``plans.oracle``. Nested results are flattened to
text, as the comparison is by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.functions.scalars import abbreviated, export_slug, zoom_bucket
from sightlines.operators import (
    areas,
    bitmaps,
    cube,
    digests,
    export,
    geometry,
    index,
    latency,
    layouts,
    locations,
    logs,
    lookups,
    observations,
    sampling,
    species,
    taxa,
    text_index,
    trees,
    upkeep,
    verdicts,
    zorder,
)
from sightlines.operators.filters import apply_filters, by_envelope
from sightlines.plans.requests import EXPORT_COLUMNS, EXPORT_NAME, REQUESTS, SEARCH_PREFIX, TAXON_TERM
from sightlines.sources import OccurrenceTables, sinks, supplied_tables
from sightlines.sources.shared import new_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(build: Callable[[OccurrenceTables], DataFrame]) -> Callable[[OccurrenceTables], DataFrame]:
    """Register ``build`` under its own name."""
    _QUERIES[build.__name__] = lambda spark, sf_dir: build(supplied_tables(spark, sf_dir))
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- index -------------------------------------------------------------------


@_query
def index_areas(t: OccurrenceTables) -> DataFrame:
    return index.index_areas(t)


@_query
def index_institutions(t: OccurrenceTables) -> DataFrame:
    return index.index_institutions(t)


@_query
def index_all(t: OccurrenceTables) -> DataFrame:
    return index.index_all(t)


@_query
def index_enriched(t: OccurrenceTables) -> DataFrame:
    return index.index_enriched(t)


@_query
def index_backfill(t: OccurrenceTables) -> DataFrame:
    """A run that finds the institution rows finished and every area row marked."""
    full = index.index_enriched(t)
    finished = full.where(F.col("entity_type_id") == codes.INSTITUTION)
    marked = index.as_unfilled(index.index_areas(t))
    return index.backfill(finished.unionByName(marked), t)


@_query
def backfill_resumed(t: OccurrenceTables) -> DataFrame:
    """A backfill of a stored index in batches that ends after its first job and is taken up again."""
    marked = stored(index.as_unfilled(index.index_all(t)), "unfilled")
    path = new_folder(t.spark, "backfill")
    highest = t.observation.agg(F.max("observation_id")).first()[0] or 0
    batch_ids = highest // 3 + 1
    upkeep.backfill_batches(marked, t, path, batch_ids, together=2, jobs=1)
    upkeep.backfill_batches(marked, t, path, batch_ids, together=2)
    return upkeep.batched_index(t.spark, path)


@_query
def index_changed(t: OccurrenceTables) -> DataFrame:
    """An older index brought up to date: observations came, moved to another location and went."""
    came, moved = "observation_id % 10 = 3", "observation_id % 9 = 1"
    rows = t.observation
    older = rows.where(f"NOT ({came})").withColumn(
        "location_id", F.expr(f"IF({moved}, location_id + 1, location_id)")
    )
    gone = rows.where("observation_id % 8 = 5").withColumn("observation_id", F.expr("observation_id + 1000000000000L"))
    path = new_folder(t.spark, "changed")
    batch_ids = 5_000
    upkeep.write_batched_index(index.index_enriched(t.with_table("observation", older.unionByName(gone))), path, batch_ids)
    changed = rows.where(f"({came}) OR ({moved})").select("observation_id").unionByName(gone.select("observation_id"))
    upkeep.merge_changes(changed, t, path, batch_ids)
    return upkeep.batched_index(t.spark, path)


@_query
def stored_index(t: OccurrenceTables) -> DataFrame:
    """The index written and read back."""
    full = index.index_enriched(t)
    path = new_folder(full.sparkSession, "entity_index")
    index.write_entity_index(full, path)
    return full.sparkSession.read.parquet(path).select(*full.columns)


@_query
def stored_lines(t: OccurrenceTables) -> DataFrame:
    """Location lines written as text and read back."""
    lines = locations.location_lines(locations.requested_locations(t, REQUESTS["locations"]))
    path = new_folder(lines.sparkSession, "location_lines")
    sinks.write_lines(lines, path)
    return lines.sparkSession.read.text(path).selectExpr("value AS line")


@_query
def location_file(t: OccurrenceTables) -> DataFrame:
    """The location document written as one file by many tasks and read back, line by line."""
    f = REQUESTS["locations"]
    located = locations.requested_locations(t, f)
    path = new_folder(located.sparkSession, "location_document")
    sinks.write_location_document(located, path, f.epsg)
    return located.sparkSession.read.text(path).selectExpr("value AS line")


@_query
def stored_csv(t: OccurrenceTables) -> DataFrame:
    """An export written as CSV and read back."""
    rows = export.export_rows(t, REQUESTS["export_rows"], ("id", "CollectionCode", "TaxonId"))
    path = new_folder(rows.sparkSession, "export")
    sinks.write_csv(rows, path)
    read = rows.sparkSession.read.option("header", True).option("sep", ";").csv(path)
    return read.selectExpr("CAST(Id AS BIGINT) AS observation_id", "Samlingskode AS collection_code")


@_query
def zoom_levels(t: OccurrenceTables) -> DataFrame:
    blank = t.area.withColumn("zoom_level", F.when(F.col("area_type_id") > 2, F.col("zoom_level")))
    return index.with_zoom_levels(blank).select("area_id", "area_type_id", "zoom_level")


# --- filters -----------------------------------------------------------------

_FILTERED = ("observation_id", "taxon_group_id", "basis_of_record_id", "collection_code")
_EXPORT_MODE = {"f_combined_export"}


def _filter_query(name: str, route: str = "auto") -> Query:
    mode = "export" if name in _EXPORT_MODE else "search"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, f = supplied_tables(spark, sf_dir), REQUESTS[name]
        matching = apply_filters(t.observation, t, f, mode=mode, route=route)
        return by_envelope(matching, t, f.envelope).select(*_FILTERED)

    return run


for _name in REQUESTS:
    if _name.startswith("f_"):
        _QUERIES[_name] = _filter_query(_name)
_QUERIES["f_geo_or_index"] = _filter_query("f_geo_or", route="index")


# --- contains-search through the trigram index ---------------------------------


def _text_indexed(t: OccurrenceTables, *fields: tuple[str, str]) -> OccurrenceTables:
    """The tables with a stored text index of some columns."""
    path = new_folder(t.spark, "text_index")
    text_index.write_text_index(text_index.text_rows(t, fields), path)
    return t.with_text_index(path)


def _text_query(request: str, *fields: tuple[str, str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _text_indexed(supplied_tables(spark, sf_dir), *fields)
        return apply_filters(t.observation, t, REQUESTS[request]).select(*_FILTERED)

    return run


_NAME_FIELDS = (
    ("taxon", "preferred_popular_name"), ("taxon_name", "scientific_name"), ("taxon_name", "scientific_name_authorship"),
)
for _name, _request, _fields in (
    ("text_catalog", "f_catalog", (("observation", "catalog_number"),)),
    ("text_literal", "f_like_literal", (("observation", "catalog_number"),)),
    ("text_collection", "f_collection", (("observation", "collection_code"),)),
    ("text_short", "text_short", (("observation", "collection_code"),)),
    ("text_project", "f_project_name", (("organization", "name"),)),
    ("text_names", "f_text", _NAME_FIELDS),
):
    _QUERIES[_name] = _text_query(_request, *_fields)


@_query
def text_taxa(t: OccurrenceTables) -> DataFrame:
    t = _text_indexed(t, ("taxon_name", "scientific_name"), ("taxon_popular_name", "name"))
    return taxa.taxon_search(t, TAXON_TERM, 40)


@_query
def text_organizations(t: OccurrenceTables) -> DataFrame:
    return lookups.organization_search(_text_indexed(t, ("organization", "name")), SEARCH_PREFIX, 30)


@_query
def text_postings(t: OccurrenceTables) -> DataFrame:
    """The ids of every piece of the popular names."""
    found = text_index.postings(text_index.text_rows(t, (("taxon", "preferred_popular_name"),)))
    ids = found.select("piece", "chunk", F.explode("offsets").alias("offset"))
    return ids.selectExpr(
        "replace(piece, chr(0), '$') AS piece", f"shiftleft(chunk, {text_index.CHUNK_BITS}) | CAST(offset AS BIGINT) AS taxon_id"
    )


# --- facet bitmaps -------------------------------------------------------------


def _bitmapped(t: OccurrenceTables) -> OccurrenceTables:
    path = new_folder(t.spark, "bitmaps")
    bitmaps.write_facet_bitmaps(t, path)
    return t.with_bitmaps(path)


@_query
def bitmap_geo_or(t: OccurrenceTables) -> DataFrame:
    t = _bitmapped(t)
    return bitmaps.apply_bitmaps(t.observation, t, REQUESTS["f_geo_or"]).select(*_FILTERED)


@_query
def bitmap_combined_search(t: OccurrenceTables) -> DataFrame:
    """Bitmaps for what they answer, the text filter on the rows that are left."""
    t = _bitmapped(t)
    return bitmaps.apply_bitmaps(t.observation, t, REQUESTS["f_combined_search"]).select(*_FILTERED)


@_query
def bitmap_combined_export(t: OccurrenceTables) -> DataFrame:
    t = _bitmapped(t)
    return bitmaps.apply_bitmaps(t.observation, t, REQUESTS["f_combined_export"], mode="export").select(*_FILTERED)


@_query
def bitmap_export_count(t: OccurrenceTables) -> DataFrame:
    return _bitmapped(t).bitmaps.count(REQUESTS["f_combined_export"], mode="export")


@_query
def bitmap_ids(t: OccurrenceTables) -> DataFrame:
    return _bitmapped(t).bitmaps.ids(REQUESTS["f_status_2"])


@_query
def bitmap_area_counts(t: OccurrenceTables) -> DataFrame:
    return areas.area_counts(_bitmapped(t), 2, REQUESTS["area_counts_dynamic"])


@_query
def bitmap_area_counts_geo(t: OccurrenceTables) -> DataFrame:
    return areas.area_counts(_bitmapped(t), 1, REQUESTS["area_counts_geo"])


# --- data cube -----------------------------------------------------------------


def _cubed(t: OccurrenceTables) -> OccurrenceTables:
    path = new_folder(t.spark, "cube")
    cube.write_cube(cube.base_cells(t.enriched_index), path)
    return t.with_cube(path)


@_query
def cube_area_counts(t: OccurrenceTables) -> DataFrame:
    return areas.area_counts(_cubed(t), 2, REQUESTS["area_counts_dynamic"])


@_query
def cube_area_markers(t: OccurrenceTables) -> DataFrame:
    return areas.area_markers(_cubed(t), 2, REQUESTS["area_markers_dynamic"])


@_query
def cube_area_months(t: OccurrenceTables) -> DataFrame:
    return areas.counts_response(_cubed(t), 1, REQUESTS["area_counts_months"])


@_query
def cube_cells(t: OccurrenceTables) -> DataFrame:
    """All cuboids by their number of cells and of observations."""
    cells = cube.cuboid_cells(cube.base_cells(t.enriched_index))
    return cells.groupBy("cuboid").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))


@_query
def cube_merged(t: OccurrenceTables) -> DataFrame:
    """Counts by group and category after a third of the observations came and a seventh went."""
    rows = t.enriched_index
    came, went = "observation_id % 3 = 0", "observation_id % 7 = 0"
    base = cube.base_cells(rows.where(f"NOT ({came})"))
    merged = cube.merged_cells(base, cube.base_cells(rows.where(came)), cube.base_cells(rows.where(went)))
    return (
        cube.cuboid_cells(merged).where(f"cuboid = {cube.CUBOIDS.index(('taxon_group_id', 'category_id'))}")
        .select("entity_type_id", "entity_id", "taxon_group_id", "category_id", "n")
    )


# --- locations ---------------------------------------------------------------


@_query
def locations_top(t: OccurrenceTables) -> DataFrame:
    return locations.requested_locations(t, REQUESTS["locations"])


_QUERIES["locations"] = _QUERIES.pop("locations_top")


@_query
def locations_envelope(t: OccurrenceTables) -> DataFrame:
    return locations.requested_locations(t, REQUESTS["locations_envelope"])


def _z_ordered(t: OccurrenceTables) -> OccurrenceTables:
    path = new_folder(t.spark, "locations")
    zorder.write_z_ordered(t.location, path)
    return t.with_z_ordered_locations(path)


@_query
def z_locations_envelope(t: OccurrenceTables) -> DataFrame:
    return locations.requested_locations(_z_ordered(t), REQUESTS["locations_envelope"])


@_query
def z_polygons(t: OccurrenceTables) -> DataFrame:
    return geometry.requested_polygons(_z_ordered(t), REQUESTS["polygons"])


@_query
def z_envelope(t: OccurrenceTables) -> DataFrame:
    t, f = _z_ordered(t), REQUESTS["f_envelope"]
    return by_envelope(t.observation, t, f.envelope).select(*_FILTERED)


@_query
def location_lines(t: OccurrenceTables) -> DataFrame:
    return locations.location_lines(locations.requested_locations(t, REQUESTS["locations"]))


@_query
def location_document(t: OccurrenceTables) -> DataFrame:
    return locations.location_document(t, REQUESTS["locations"])


# --- observation list --------------------------------------------------------


@_query
def observations_page(t: OccurrenceTables) -> DataFrame:
    return observations.requested_observations(t, REQUESTS["observations_page"])


@_query
def observations_default(t: OccurrenceTables) -> DataFrame:
    return observations.requested_observations(t, REQUESTS["observations_default"])


@_query
def observations_deep(t: OccurrenceTables) -> DataFrame:
    """A page far down the unfiltered list, located by id ranges."""
    rows = t.observation.select("observation_id", "taxon_group_id")
    return observations.located_window(rows, "observation_id", skip=900, take=80)


@_query
def observations_scattered(t: OccurrenceTables) -> DataFrame:
    """A window over both parts of a list whose keys lie far apart."""
    far = "IF(observation_id % 5 = 0, observation_id + 1000000000000000L, observation_id) AS observation_id"
    rows = t.observation.selectExpr(far, "taxon_group_id")
    n = rows.count()
    return observations.located_window(rows, "observation_id", skip=n - n // 5 - 30, take=60, few=50)


@_query
def observations_all(t: OccurrenceTables) -> DataFrame:
    return observations.observations(t, REQUESTS["observations_default"])


@_query
def observations_colocated(t: OccurrenceTables) -> DataFrame:
    """All matching observations with their list columns, from tables in equal buckets."""
    path = new_folder(t.spark, "layout")
    layout = layouts.write_layout(t, path.rsplit("/", 1)[-1].replace("-", "_"), path, buckets=8)
    return observations.observations(t.with_layout(layout), REQUESTS["observations_default"])


@_query
def locations_all(t: OccurrenceTables) -> DataFrame:
    return locations.locations(t, REQUESTS["locations"])


@_query
def observations_after(t: OccurrenceTables) -> DataFrame:
    rows = t.observation.select("observation_id", "taxon_group_id")
    return observations.rows_after(rows, "observation_id", last=700, take=200)


def _paged(request: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _bitmapped(supplied_tables(spark, sf_dir))
        return observations.page_ids(t, REQUESTS[request])

    return run


for _name in ("pages_any_area", "pages_one_area", "pages_unfiltered", "pages_parts", "pages_behind"):
    _QUERIES[_name] = _paged(_name)


@_query
def pages_rows(t: OccurrenceTables) -> DataFrame:
    return observations.requested_observations(_bitmapped(t), REQUESTS["pages_any_area"])


@_query
def page_meta(t: OccurrenceTables) -> DataFrame:
    f = REQUESTS["page_meta"]
    return observations.page_meta(observations.page_ids(t, f), f)


# --- areas -------------------------------------------------------------------


@_query
def area_counts_pre(t: OccurrenceTables) -> DataFrame:
    return areas.area_counts(t, 2, REQUESTS["area_counts_pre"])


@_query
def area_counts_dynamic(t: OccurrenceTables) -> DataFrame:
    return areas.area_counts(t, 2, REQUESTS["area_counts_dynamic"])


@_query
def area_counts_subquery(t: OccurrenceTables) -> DataFrame:
    return areas.area_counts(t, 1, REQUESTS["area_counts_subquery"])


@_query
def area_counts_geo(t: OccurrenceTables) -> DataFrame:
    return areas.area_counts(t, 1, REQUESTS["area_counts_geo"])


@_query
def area_counts_fallback(t: OccurrenceTables) -> DataFrame:
    return areas.area_counts(t, 2, REQUESTS["area_counts_fallback"])


@_query
def area_counts_months(t: OccurrenceTables) -> DataFrame:
    return areas.counts_response(t, 1, REQUESTS["area_counts_months"])


@_query
def area_counts_compat(t: OccurrenceTables) -> DataFrame:
    return areas.counts_response(t, 1, REQUESTS["area_counts_months"], compat=True)


@_query
def area_markers(t: OccurrenceTables) -> DataFrame:
    return areas.area_markers(t, 1)


@_query
def area_markers_dynamic(t: OccurrenceTables) -> DataFrame:
    return areas.area_markers(t, 2, REQUESTS["area_markers_dynamic"])


@_query
def area_rollup(t: OccurrenceTables) -> DataFrame:
    return areas.area_counts(t, 1, REQUESTS["area_rollup"])


@_query
def area_select(t: OccurrenceTables) -> DataFrame:
    f = REQUESTS["area_select"]
    return areas.select_areas(areas.load_areas(t, 1, f), t, f).select("area_id", "fid", "name")


@_query
def area_zero_fill(t: OccurrenceTables) -> DataFrame:
    f = REQUESTS["area_zero_fill"]
    dynamic = f.but(taxon_group_ids=(1, 2))
    counts = areas.area_counts(t, 2, dynamic)
    return areas.merge_counts(areas.load_areas(t, 2, f), counts, f).select("area_id", "fid", "observation_count")


@_query
def area_ocean_append(t: OccurrenceTables) -> DataFrame:
    return areas.load_areas(t, 3, REQUESTS["area_ocean_append"]).select("area_id", "fid", "area_type_id")


@_query
def hierarchy(t: OccurrenceTables) -> DataFrame:
    return areas.hierarchy_triples(t.area)


@_query
def hierarchy_lists(t: OccurrenceTables) -> DataFrame:
    return areas.county_municipalities(t.area).select(
        "county_fid", F.array_join("municipality_fids", ",").alias("municipality_fids")
    )


@_query
def hierarchy_prefix(t: OccurrenceTables) -> DataFrame:
    return areas.prefix_groups(t.area)


def _area_nodes(t: OccurrenceTables) -> DataFrame:
    """Counties and municipalities by fid."""
    kinds = F.col("area_type_id").isin(codes.COUNTY, codes.MUNICIPALITY)
    return t.area.where(kinds & F.col("is_current")).selectExpr("fid AS node", "parent_fid AS parent")


def _place_nodes(t: OccurrenceTables) -> DataFrame:
    """Four levels: everything, counties, municipalities, the locations in them."""
    top = t.spark.range(1).selectExpr("'all' AS node", "CAST(NULL AS STRING) AS parent")
    kept = t.area.where("is_current")
    counties = kept.where(f"area_type_id = {codes.COUNTY}").selectExpr("concat('c', fid) AS node", "'all' AS parent")
    within = kept.where(f"area_type_id = {codes.MUNICIPALITY}")
    towns = within.selectExpr("concat('m', fid) AS node", "concat('c', parent_fid) AS parent")
    places = t.location_area.join(within.select("area_id", "fid"), "area_id").selectExpr(
        "concat('l', location_id) AS node", "concat('m', fid) AS parent"
    )
    return top.union(counties).union(towns).union(places)


@_query
def tree_closure(t: OccurrenceTables) -> DataFrame:
    return trees.closure(_area_nodes(t))


@_query
def tree_labels(t: OccurrenceTables) -> DataFrame:
    nodes = _place_nodes(t)
    return trees.labels(nodes, trees.closure(nodes))


@_query
def tree_rollup(t: OccurrenceTables) -> DataFrame:
    """Observations of every place on all levels."""
    counts = t.observation.groupBy(F.expr("concat('l', location_id)").alias("node")).agg(F.count("*").alias("n"))
    return trees.rolled_up(trees.closure(_place_nodes(t)), counts.where("node IS NOT NULL"))


@_query
def digest_changes(t: OccurrenceTables) -> DataFrame:
    """Where observations changed: some moved to another group, some came and some went; level by level from the top."""
    nodes = _place_nodes(t)
    pairs = stored(trees.closure(nodes), "pairs")
    rows = t.observation.select("observation_id", "taxon_group_id", "category_id", F.expr("concat('l', location_id)").alias("place"))
    moved = F.expr("IF(observation_id % 997 = 5, taxon_group_id + 1, taxon_group_id)")
    after = rows.where("observation_id % 499 <> 7").withColumn("taxon_group_id", moved)
    columns = ["observation_id", "taxon_group_id", "category_id"]
    old, new = (
        stored(digests.along_tree(pairs, digests.digested(r.where("place IS NOT NULL"), "place", columns)), "digests")
        for r in (rows, after)
    )
    return digests.changed_below(old, new, nodes, "all")


@_query
def request_verdicts(t: OccurrenceTables) -> DataFrame:
    """Requests made of the log's rows, judged rule by rule."""
    rows = t.request_log.selectExpr(
        "request_id",
        "element_at(array('search', 'page', 'counts', 'locations'), CAST(request_id % 4 AS INT) + 1) AS kind",
        "CAST(elapsed_ms % 1200 AS INT) AS list_items", "CAST(elapsed_ms % 7 - 1 AS INT) AS precision_from",
        "CAST(request_id % 5 AS INT) AS precision_to",
        "IF(request_id % 3 = 0, NULL, CAST(elapsed_ms % 9 - 1 AS INT)) AS page_number",
        "IF(request_id % 11 = 0, NULL, CAST(elapsed_ms % 12000 AS INT)) AS results_per_page",
        "CAST(elapsed_ms % 4 AS INT) AS zoom_level", "CAST(elapsed_ms * 13 % 110000 AS INT) AS max_results",
        "CAST(elapsed_ms % 10 AS DOUBLE) AS min_x", "0.0D AS min_y", "5.0D AS max_x",
        "IF(request_id % 2 = 0, NULL, CAST(elapsed_ms % 3 AS DOUBLE)) AS max_y",
    )
    return verdicts.verdicts(rows)


@_query
def latency_quantiles(t: OccurrenceTables) -> DataFrame:
    """Hours of the log; a third of it is there twice."""
    log = t.request_log
    return latency.quantiles(latency.latency_cells(log.unionByName(log.where("request_id % 3 = 0"))))


@_query
def area_collapse(t: OccurrenceTables) -> DataFrame:
    f = REQUESTS["area_collapse"]
    return areas.collapse_selection(_padded(t.area), f.municipality_ids, f.county_ids)


def _padded(area: DataFrame) -> DataFrame:
    """Municipality fids as four digits, so that their first two name the county."""
    kind = F.col("area_type_id")
    two_digit = F.when(
        kind == codes.MUNICIPALITY, F.concat(F.lpad("parent_fid", 2, "0"), F.substring("fid", 2, 2))
    ).otherwise(F.col("fid"))
    unpadded = F.regexp_replace(two_digit, "^0", "")
    return area.withColumn("fid", unpadded)


# --- taxa and lookups --------------------------------------------------------


@_query
def taxon_search(t: OccurrenceTables) -> DataFrame:
    return taxa.taxon_search(t, TAXON_TERM, 40)


@_query
def taxon_union(t: OccurrenceTables) -> DataFrame:
    return taxa.taxon_union(t, TAXON_TERM).select("taxon_id", "preferred_popular_name")


def _listing(items: str, *fields: str) -> Column:
    def text(item: Column) -> Column:
        return F.concat_ws(":", *[item[f].cast("string") for f in fields])

    return F.array_join(F.transform(items, text), "|")


@_query
def lookup_categories(t: OccurrenceTables) -> DataFrame:
    return lookups.category_tree(t).select(
        "category_type_id", "type_name",
        _listing("categories", "name", "category_id", "code", "observation_count").alias("categories"),
    )


@_query
def lookup_category_rows(t: OccurrenceTables) -> DataFrame:
    return lookups.category_rows(t).select("category_type_id", "type_name", "category_name", "code")


@_query
def lookup_areas(t: OccurrenceTables) -> DataFrame:
    return lookups.area_tree(t).select(
        "area_type_id", "type_name", _listing("areas", "name", "area_id", "fid").alias("areas")
    )


@_query
def lookup_area_rows(t: OccurrenceTables) -> DataFrame:
    return lookups.area_rows(t).select("area_type_id", "type_name", "area_name", "fid")


@_query
def area_slots(t: OccurrenceTables) -> DataFrame:
    slots = lookups.area_slots(t)
    return slots.select(
        *[F.col(f"{s}.type_name").alias(f"{s}_type") for s in lookups.AREA_SLOTS],
        *[F.size(f"{s}.areas").alias(f"{s}_size") for s in lookups.AREA_SLOTS],
    )


@_query
def institutions(t: OccurrenceTables) -> DataFrame:
    return lookups.institutions(t)


@_query
def org_search(t: OccurrenceTables) -> DataFrame:
    return lookups.organization_search(t, SEARCH_PREFIX, 30)


@_query
def taxon_groups(t: OccurrenceTables) -> DataFrame:
    return lookups.taxon_groups(t).select("taxon_group_id", "name")


@_query
def behaviors(t: OccurrenceTables) -> DataFrame:
    """After the soft-delete carry-over."""
    carried = t.with_table("behavior", index.carry_soft_delete(t.behavior))
    return lookups.behaviors(carried).select("behavior_id", "name", "variants", "observation_count")


@_query
def basis_of_records(t: OccurrenceTables) -> DataFrame:
    """With the appended DNA rows."""
    extended = t.with_table("basis_of_record", index.with_dna_basis(t.basis_of_record))
    return lookups.basis_of_records(extended).select("basis_of_record_id", "name", "variants", "description")


@_query
def variant_lists(t: OccurrenceTables) -> DataFrame:
    rows = lookups.split_variants(t.behavior, "behavior_id")
    return lookups.joined_variants(rows, "behavior_id")


@_query
def category_order(t: OccurrenceTables) -> DataFrame:
    return lookups.ordered_categories(t)


# --- export ------------------------------------------------------------------


@_query
def export_rows(t: OccurrenceTables) -> DataFrame:
    return export.export_rows(t, REQUESTS["export_rows"], EXPORT_COLUMNS, headers=False)


@_query
def export_lines(t: OccurrenceTables) -> DataFrame:
    rows = export.export_rows(t, REQUESTS["export_rows"], EXPORT_COLUMNS)
    return export.export_lines(rows, "Id")


@_query
def export_summary(t: OccurrenceTables) -> DataFrame:
    return export.export_summary(
        t, REQUESTS["export_summary"], EXPORT_COLUMNS, EXPORT_NAME, soft_limit=1_000, hard_limit=100_000
    )


@_query
def export_limit(t: OccurrenceTables) -> DataFrame:
    matching = apply_filters(t.observation, t, REQUESTS["export_rows"], mode="export")
    return export.limit_check(matching, 2_000)


@_query
def export_jobs(t: OccurrenceTables) -> DataFrame:
    jobs = export.parsed_jobs(t.export_job)
    f = F.col("filter")
    return jobs.select(
        "job_id",
        F.array_join(f["TaxonGroupIds"].cast("array<string>"), ",").alias("taxon_groups"),
        F.array_join(f["CountyIds"], ",").alias("counties"),
        f["Period"]["From"].alias("period_from"),
        F.array_join(f["Period"]["Months"].cast("array<string>"), ",").alias("months"),
        F.size("columns").alias("column_count"),
    )


@_query
def export_job_columns(t: OccurrenceTables) -> DataFrame:
    return export.known_job_columns(t.export_job).select("job_id", "position", "column", "header")


@_query
def slug(t: OccurrenceTables) -> DataFrame:
    return t.export_job.selectExpr("job_id", f"{export_slug('name')} AS slug")


# --- samples, geometry -------------------------------------------------------


@_query
def sample_taxa(t: OccurrenceTables) -> DataFrame:
    return sampling.sample_taxa(t).select("taxon_id", "taxon_rank_id", "taxon_group_id", "exists_in_country")


@_query
def sample_observations(t: OccurrenceTables) -> DataFrame:
    return sampling.sample_observations(t).select("observation_id", "category_id", "taxon_id", "taxon_group_id")


@_query
def sample_locations(t: OccurrenceTables) -> DataFrame:
    return sampling.sample_locations(t)


@_query
def polygons(t: OccurrenceTables) -> DataFrame:
    return geometry.requested_polygons(t, REQUESTS["polygons"])


@_query
def polygons_all(t: OccurrenceTables) -> DataFrame:
    return geometry.requested_polygons(t, REQUESTS["polygons_all"])


@_query
def wkt_bbox(t: OccurrenceTables) -> DataFrame:
    return geometry.with_bounds(t.location, "geometry_wkt").select("location_id", *geometry.BOX)


@_query
def bbox_overlap(t: OccurrenceTables) -> DataFrame:
    """Location shapes against the viewports."""
    shapes = geometry.with_bounds(t.location, "geometry_wkt").select("location_id", *geometry.BOX)
    return geometry.overlapping(shapes, t.viewport).select("location_id", "viewport_id")


@_query
def area_centroids(t: OccurrenceTables) -> DataFrame:
    return geometry.with_centroids(t.area).select("area_id", "centroid_x", "centroid_y")


def _marked_areas(t: OccurrenceTables) -> DataFrame:
    return geometry.with_centroids(t.area.where("is_current"))


@_query
def viewport_markers(t: OccurrenceTables) -> DataFrame:
    return geometry.viewport_markers(_marked_areas(t), t.viewport).select(
        "viewport_id", "area_id", "fully_visible", "marker_x", "marker_y"
    )


@_query
def viewport_spread(t: OccurrenceTables) -> DataFrame:
    """Viewports of other heights and widths: some cover whole areas, some cut them above, below or at a side."""
    views = t.viewport.selectExpr(
        "viewport_id", "min_x - 1.5D AS min_x", "viewport_id - 2.0D AS min_y", "max_x + viewport_id AS max_x",
        "viewport_id * 2 + 2.5D AS max_y",
    )
    return geometry.viewport_markers(_marked_areas(t), views).select(
        "viewport_id", "area_id", "fully_visible", "marker_x", "marker_y"
    )


@_query
def area_slot_members(t: OccurrenceTables) -> DataFrame:
    """The members of the five slots with their places in the lists."""
    slots = lookups.area_slots(t)
    every = F.array(*[
        F.struct(F.lit(s).alias("slot"), F.col(f"{s}.type_name").alias("type_name"), F.col(f"{s}.areas").alias("areas"))
        for s in lookups.AREA_SLOTS
    ])
    rows = slots.select(F.inline(every)).selectExpr("slot", "type_name", "posexplode(areas) AS (place, member)")
    return rows.selectExpr("slot", "type_name", "place", "member.area_id", "member.fid", "member.name", "member.observation_count")


@_query
def geojson_features(t: OccurrenceTables) -> DataFrame:
    return geometry.area_features(_marked_areas(t), t.viewport)


@_query
def geojson_locations(t: OccurrenceTables) -> DataFrame:
    return geometry.location_features(locations.requested_locations(t, REQUESTS["locations"]))


@_query
def geojson_polygons(t: OccurrenceTables) -> DataFrame:
    return geometry.polygon_features(geometry.requested_polygons(t, REQUESTS["polygons_all"]))


@_query
def geojson_overlays(t: OccurrenceTables) -> DataFrame:
    f = REQUESTS["area_select"]
    return geometry.overlay_features(t.area.where("is_current"), f.municipality_ids + f.county_ids)


# --- species, logs, scalars --------------------------------------------------


@_query
def species_normalised(t: OccurrenceTables) -> DataFrame:
    records = species.species_records(t.species_response)
    return records.select(
        "response_id",
        "taxon_id",
        "scientific_name",
        "scientific_name_formatted",
        "author",
        "rank",
        _listing("preferred_vernacular_names", "name", "language").alias("preferred_names"),
        _listing("vernacular_name_synonyms", "name", "language").alias("other_names"),
        _listing("scientific_name_synonyms", "name", "name_formatted", "author", "rank").alias("synonyms"),
    )


@_query
def fingerprint(t: OccurrenceTables) -> DataFrame:
    return logs.fingerprint(areas.area_counts(t, 2, REQUESTS["area_counts_dynamic"]))


@_query
def history(t: OccurrenceTables) -> DataFrame:
    return logs.newest_per_user(t.export_job).select("job_id", "user_id", "status", "file_size")


@_query
def history_one_user(t: OccurrenceTables) -> DataFrame:
    return logs.history(t.export_job, "7").select("job_id", "user_id", "status", "file_size")


@_query
def expired_jobs(t: OccurrenceTables) -> DataFrame:
    now = F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")
    return logs.without_files(logs.expired_jobs(t.export_job, now)).select("job_id", "status", "file_size")


@_query
def slow_log(t: OccurrenceTables) -> DataFrame:
    return logs.slow_requests(t.request_log)


@_query
def abbrev(t: OccurrenceTables) -> DataFrame:
    counted = t.request_log.selectExpr("request_id", "elapsed_ms * request_id AS n")
    return counted.selectExpr("request_id", f"{abbreviated('n')} AS shown")


@_query
def zoom_buckets(t: OccurrenceTables) -> DataFrame:
    return t.request_log.selectExpr("request_id", f"{zoom_bucket('elapsed_ms / 100D')} AS zoom_level")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of the chosen taxon groups and areas, by number of observations."""
    return locations.requested_locations(supplied_tables(spark, sf_dir), REQUESTS["locations"])


__all__ = ["flagship", "queries"]
