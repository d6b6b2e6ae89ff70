"""The supplied benchmark tables seen through the occurrence schema.

observation <- orders, location <- customer, municipality <- nation,
county <- region, taxon <- part, organisation <- supplier, tags, behaviours and
media <- lineitem, export jobs and request log <- events. Nulls, deleted rows and
historical areas come from modulo rules, as the supplied tables have none.

The mappings are expression texts: a text is one call to the JVM, where a tree of
column objects is one call per node.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from sightlines import schema
from sightlines.sources.shared import dealt, partitions_for, shuffle_partitions
from sightlines.sources.tables import OccurrenceTables

Raw = Callable[[str], DataFrame]


def supplied_tables(spark: SparkSession, sf_dir: str) -> OccurrenceTables:
    """Occurrence tables over one scale-factor folder."""

    def raw(name: str) -> DataFrame:
        return spark.read.schema(schema.SUPPLIED[name]).parquet(f"{sf_dir}/{name}.parquet")

    return OccurrenceTables(spark, {name: partial(build, raw) for name, build in _MAPPINGS.items()})


_GROUP_NUMBER = "CAST(substring(p_brand, 7) AS INT)"


def _taxon_group(raw: Raw) -> DataFrame:
    return raw("part").selectExpr(
        f"{_GROUP_NUMBER} AS taxon_group_id",
        "p_brand AS name",
        "CAST(NULL AS INT) AS observation_count",
        "FALSE AS is_deleted",
    ).distinct()


def _taxon(raw: Raw) -> DataFrame:
    return raw("part").selectExpr(
        "p_partkey AS taxon_id",
        "p_partkey + 100000 AS external_taxon_id",
        "p_name AS valid_scientific_name",
        "p_type AS valid_scientific_name_authorship",
        "concat(p_name, ' ', p_brand) AS preferred_popular_name",
        f"{_GROUP_NUMBER} AS taxon_group_id",
        "p_size AS taxon_rank_id",
        "IF(p_partkey % 11 = 0, 0, p_size) AS cumulative_observation_count",
        "p_partkey % 2 = 0 AS exists_in_country",
        "p_partkey % 17 = 0 AS is_deleted",
    )


def _taxon_name(raw: Raw) -> DataFrame:
    """An accepted name and a synonym per part, in one scan."""
    fields = "struct({0} AS taxon_name_id, {1} AS scientific_name, {2} AS accepted, {3} AS is_deleted)"
    accepted = fields.format("p_partkey * 2", "p_name", "TRUE", "FALSE")
    synonym = fields.format("p_partkey * 2 + 1", "concat('syn ', p_name)", "FALSE", "p_partkey % 5 = 0")
    return raw("part").selectExpr(
        "p_partkey AS taxon_id", "p_type AS scientific_name_authorship", f"inline(array({accepted}, {synonym}))"
    )


def _taxon_popular_name(raw: Raw) -> DataFrame:
    return raw("part").selectExpr(
        "p_partkey AS taxon_popular_name_id",
        "p_partkey AS taxon_id",
        "concat(p_name, ' ', p_brand) AS name",
        "'nb' AS language",
        "TRUE AS preferred",
        "p_partkey % 7 = 0 AS is_deleted",
    )


def _location(raw: Raw) -> DataFrame:
    return raw("customer").selectExpr(
        "c_custkey AS location_id",
        "IF(c_custkey % 20 = 0, NULL, 58.0D + (c_custkey % 1300) / 100.0D) AS latitude",
        "5.0D + (c_custkey % 2500) / 100.0D AS longitude",
        "CAST(floor(c_acctbal * 10) AS INT) AS east",
        "CAST(6500000 + c_custkey AS INT) AS north",
        "c_name AS locality",
        """CASE c_custkey % 3
             WHEN 0 THEN concat('POLYGON ((0 0, 0 ', c_custkey, ', 9 ', c_custkey, ', 9 0, 0 0))')
             WHEN 1 THEN concat('POLYGON ((0 0, 0 ', c_custkey, ', 9 ', c_custkey, ', 0 0))')
             ELSE concat('POINT (', c_custkey, ' 1)') END AS geometry_wkt""",
    )


def _observation(raw: Raw) -> DataFrame:
    first_part = raw("lineitem").groupBy("l_orderkey").agg({"l_partkey": "min"}).withColumnsRenamed(
        {"l_orderkey": "o_orderkey", "min(l_partkey)": "first_part"}
    )
    # Into the session's number the aggregate is dealt already; into more, a join would deal the orders as the aggregate is.
    if partitions_for(raw("orders")) > shuffle_partitions(first_part.sparkSession):
        first_part = dealt(first_part, "o_orderkey", table=raw("orders"))
    orders = dealt(raw("orders"), "o_orderkey", table=raw("orders")).join(first_part, "o_orderkey", "left").selectExpr(
        "*", "coalesce(first_part, 0L) AS p_partkey"
    )
    return orders.join(raw("part").select("p_partkey", "p_brand"), "p_partkey").selectExpr(
        "o_orderkey AS observation_id",
        "IF(o_orderkey % 97 = 0, NULL, o_custkey) AS location_id",
        "p_partkey AS taxon_id",
        "p_partkey * 2 + IF(o_orderkey % 4 = 0, 1, 0) AS matched_scientific_name_id",
        f"{_GROUP_NUMBER} AS taxon_group_id",
        "CASE o_orderstatus WHEN 'F' THEN 9 WHEN 'O' THEN 11 END AS category_id",
        "CAST(substring(o_orderpriority, 1, 1) AS INT) AS basis_of_record_id",
        "IF(o_orderkey % 13 = 0, NULL, CAST(floor(o_totalprice / 100) AS INT)) AS coordinate_precision_m",
        "IF(o_orderkey % 50 = 0, NULL, o_orderdate) AS date_time_collected",
        "concat('COLL-', o_orderpriority) AS collection_code",
        "IF(o_orderkey % 9 = 0, NULL, concat('CAT_', o_orderkey)) AS catalog_number",
        "58.0D + (o_custkey % 1300) / 100.0D AS latitude",
        "5.0D + (o_custkey % 2500) / 100.0D AS longitude",
        "o_orderkey % 2 = 0 AS has_errors",
    )


def _observation_detail(raw: Raw) -> DataFrame:
    return raw("orders").where("o_orderkey % 3 <> 0").selectExpr(
        "o_orderkey AS observation_id",
        "concat('Dataset ', o_orderpriority) AS dataset_name",
        "concat('Collector ', o_custkey) AS collector",
        "concat('seen \"', o_orderstatus, '\"; noted') AS notes",
        "IF(o_orderkey % 5 = 0, NULL, 'shore') AS locality",
    )


def _observation_behavior(raw: Raw) -> DataFrame:
    lines = raw("lineitem").selectExpr("l_orderkey AS observation_id", "l_linenumber AS behavior_id")
    return dealt(lines, "observation_id", "behavior_id", table=raw("lineitem")).distinct()


def _observation_tag(raw: Raw) -> DataFrame:
    lines = raw("lineitem").where("l_quantity <= 8").selectExpr(
        "l_orderkey AS observation_id", "CASE l_returnflag WHEN 'A' THEN 5 WHEN 'R' THEN 6 ELSE 3 END AS tag_id"
    )
    return dealt(lines, "observation_id", "tag_id", table=raw("lineitem")).distinct()


def _media_file(raw: Raw) -> DataFrame:
    return raw("lineitem").where("l_linestatus = 'F' AND l_discount >= 0.08D").selectExpr(
        "l_orderkey AS observation_id", "l_partkey AS media_file_id"
    )


def _organization(raw: Raw) -> DataFrame:
    return raw("supplier").selectExpr(
        "s_suppkey AS organization_id",
        "s_name AS name",
        "concat('ORG', s_suppkey) AS code",
        "IF(s_suppkey % 2 = 0, 1, 3) AS organization_type_id",
        "s_suppkey % 19 = 0 AS is_deleted",
        "IF(s_suppkey % 6 = 0, NULL, CAST(s_suppkey AS INT)) AS observation_count",
    )


def _organization_relation(raw: Raw) -> DataFrame:
    lines = raw("lineitem").selectExpr("l_orderkey AS observation_id", "l_suppkey AS organization_id")
    return dealt(lines, "observation_id", "organization_id", table=raw("lineitem")).distinct()


_AREA_FIELDS = (
    "CAST({area_id} AS BIGINT) AS area_id, {fid} AS fid, {name} AS name, {kind} AS area_type_id, "
    "{zoom} AS zoom_level, CAST({parent} AS STRING) AS parent_fid, {current} AS is_current, "
    "{deleted} AS is_deleted, CAST({count} AS INT) AS observation_count, CAST({wkt} AS STRING) AS wkt_polygon, "
    "concat('doc-', CAST({area_id} AS BIGINT)) AS document_id"
)


def _area_struct(area_id: str, fid: str, name: str, kind: int, zoom: int, **known: str) -> str:
    blank = {"parent": "NULL", "current": "TRUE", "deleted": "FALSE", "count": "NULL", "wkt": "NULL"}
    fields = _AREA_FIELDS.format(area_id=area_id, fid=fid, name=name, kind=kind, zoom=zoom, **(blank | known))
    return f"struct({fields})"


def _area(raw: Raw) -> DataFrame:
    """A nation is a municipality and at times a reserve; a region a county, a sea and once the polar islands. Two seas share a name."""
    municipality = _area_struct(
        "1000 + n_nationkey", "CAST(100 * (n_regionkey + 1) + n_nationkey AS STRING)", "n_name", 1, 2,
        parent="n_regionkey + 1", current="n_nationkey <> 24", deleted="n_nationkey = 23", count="n_nationkey * 7",
        wkt="concat('POLYGON ((', n_nationkey, ' 0, ', n_nationkey, ' 5, ', n_nationkey + 3, ' 5, ', "
            "n_nationkey + 3, ' 0, ', n_nationkey, ' 0))')",
    )
    reserve = _area_struct(
        "3000 + n_nationkey", "concat('Naturbase VV0000', n_nationkey)", "concat('Reserve ', n_name)", 3, 3
    )
    county = _area_struct(
        "2000 + r_regionkey", "CAST(r_regionkey + 1 AS STRING)", "r_name", 2, 1, count="r_regionkey * 100"
    )
    sea = _area_struct(
        "4000 + r_regionkey", "CAST(91 + r_regionkey AS STRING)", "concat('Sea ', IF(r_regionkey = 4, 'AFRICA', r_name))", 4, 1, count="50"
    )
    polar = _area_struct("6000", "'21_99'", "'Polar islands'", 6, 1, count="5")
    nations = raw("nation").selectExpr(
        f"inline(IF(n_nationkey % 5 = 0, array({municipality}, {reserve}), array({municipality})))"
    )
    regions = raw("region").selectExpr(f"inline(IF(r_regionkey = 0, array({county}, {sea}, {polar}), array({county}, {sea})))")
    return nations.unionByName(regions)


def _area_type(raw: Raw) -> DataFrame:
    """Area types 1-4 and 6 from region; the name decides the list order."""
    return raw("region").selectExpr(
        "IF(r_regionkey = 4, 6, r_regionkey + 1) AS area_type_id",
        "concat('Type ', r_name) AS name",
        "FALSE AS is_deleted",
    )


def _location_area(raw: Raw) -> DataFrame:
    """A customer lies in its nation and region, and under conditions in three other areas; one scan."""
    regions = raw("nation").selectExpr("n_nationkey AS c_nationkey", "n_regionkey")
    return raw("customer").join(regions, "c_nationkey").selectExpr(
        "c_custkey AS location_id",
        """explode(CAST(array_compact(array(
             1000 + c_nationkey,
             2000 + n_regionkey,
             IF(c_nationkey % 5 = 0 AND c_custkey % 3 = 0, 3000 + c_nationkey, NULL),
             IF(c_mktsegment = 'BUILDING', 4000 + n_regionkey, NULL),
             IF(c_custkey % 101 = 0, 6000, NULL))) AS ARRAY<BIGINT>)) AS area_id""",
    )


def _category_type(raw: Raw) -> DataFrame:
    own = "struct(r_regionkey AS category_type_id, r_name AS name, r_regionkey = 3 AS is_deleted)"
    empty = "struct(99 AS category_type_id, 'Empty type' AS name, FALSE AS is_deleted)"
    return raw("region").selectExpr(f"inline(IF(r_regionkey = 0, array({own}, {empty}), array({own})))")


def _category(raw: Raw) -> DataFrame:
    return raw("nation").selectExpr(
        "n_nationkey AS category_id",
        "n_name AS name",
        "n_regionkey AS category_type_id",
        "CASE n_nationkey % 5 WHEN 0 THEN 'SE' WHEN 1 THEN 'CR' WHEN 2 THEN 'LC' WHEN 3 THEN 'NE' ELSE 'XX' END AS code",
        "n_nationkey * 3 AS observation_count",
        "n_nationkey % 8 = 0 AS is_deleted",
    )


def _behavior(raw: Raw) -> DataFrame:
    """Behaviours before the soft-delete carry-over: they still hold the legacy flag."""
    return raw("lineitem").groupBy("l_linenumber").count().selectExpr(
        "l_linenumber AS behavior_id",
        "concat('behaviour ', l_linenumber) AS name",
        "concat('b', l_linenumber, ',Behaviour ', l_linenumber, ',bhv', l_linenumber) AS variants",
        "CAST(NULL AS STRING) AS description",
        "CAST(count AS INT) AS observation_count",
        "FALSE AS is_deleted",
        "l_linenumber % 4 = 0 AS legacy_deleted",
    )


def _basis_of_record(raw: Raw) -> DataFrame:
    return raw("orders").groupBy("o_orderpriority").count().selectExpr(
        "CAST(substring(o_orderpriority, 1, 1) AS INT) AS basis_of_record_id",
        "o_orderpriority AS name",
        "concat('Basis ', o_orderpriority) AS description",
        "o_orderpriority AS variants",
        "CAST(count AS INT) AS observation_count",
        "FALSE AS is_deleted",
    )


def _export_job(raw: Raw) -> DataFrame:
    return raw("events").selectExpr(
        "event_id AS job_id",
        "CAST(user_id AS STRING) AS user_id",
        "concat(event_type, ' æ/', event_id, '!') AS name",
        """CASE event_type WHEN 'view' THEN 'Complete' WHEN 'click' THEN 'Complete' WHEN 'purchase' THEN 'Failed'
             WHEN 'signup' THEN 'Cancelled' ELSE 'Pending' END AS status""",
        """concat('{"TaxonGroupIds":[', event_id % 25 + 1, '],"CountyIds":["', event_id % 5 + 1,
             '"],"Period":{"From":', 1995 + event_id % 4, ',"To":null,"Months":[5,6]}}') AS filter_json""",
        """IF(event_id % 3 = 0, '["Id","Detail.Notes","Bogus"]', '[]') AS selected_columns""",
        "CAST(floor(value) AS BIGINT) AS file_size",
        "IF(event_id % 4 = 0, NULL, concat('exports/', event_id, '.csv')) AS blob_path",
        "CAST(NULL AS STRING) AS excel_blob_path",
        "ts AS created_at",
        "IF(event_type = 'error', NULL, ts) AS completed_at",
        "IF(event_type = 'view', ts + INTERVAL 10 DAYS, NULL) AS expires_at",
    )


def _request_log(raw: Raw) -> DataFrame:
    return raw("events").selectExpr(
        "event_id AS request_id",
        "event_type AS endpoint",
        "CAST(floor(value * 10) AS BIGINT) AS elapsed_ms",
        "props AS request_body",
        "ts AS occurred_at",
    )


def _species_response(raw: Raw) -> DataFrame:
    """Two JSON shapes: even keys answer a search, odd keys a look-up by id."""
    name = "struct(p_name AS name, concat('<i>', p_name, '</i>') AS nameFormatted, p_type AS author, 'species' AS rank)"
    search = f"""to_json(struct(
        CAST(p_partkey AS INT) AS taxonId,
        {name} AS acceptedScientificName,
        array(struct(p_brand AS name, 'nb' AS nameLanguageIso)) AS preferredVernacularNames,
        array(struct(concat(p_brand, ' two') AS name, 'nn' AS nameLanguageIso)) AS vernacularNameSynonyms,
        array({name}) AS scientificNameSynonyms))"""

    def scientific(status: str, prefix: str) -> str:
        return (
            f"struct({status} AS taxonomicStatus, concat('{prefix}', p_name) AS scientificNamePresentation, "
            f"concat('<i>{prefix}', p_name, '</i>') AS scientificNamePresentationHtml, "
            "p_type AS scientificNameAuthorship, 'species' AS taxonRank)"
        )

    def vernacular(suffix: str, status: str) -> str:
        return (
            f"struct(concat(p_brand, '{suffix}') AS vernacularName, '{status}' AS vernacularNameStatus, "
            "'nb' AS languageIsoCode)"
        )

    accepted = scientific("IF(p_partkey % 7 = 0, 'Uncertain', 'Accepted')", "")
    synonym = scientific("'Synonym'", "syn ")
    by_id = f"""to_json(struct(
        CAST(p_partkey AS INT) AS taxonId,
        array({synonym}, {accepted}) AS scientificNames,
        array({vernacular('', 'Recommended')}, {vernacular(' two', 'Allowed')}) AS vernacularNames))"""
    return raw("part").selectExpr(
        "p_partkey AS response_id",
        "IF(p_partkey % 2 = 0, 'search', 'by_id') AS shape",
        f"IF(p_partkey % 2 = 0, {search}, {by_id}) AS body",
    )


def _viewport(raw: Raw) -> DataFrame:
    return raw("region").selectExpr(
        "r_regionkey AS viewport_id",
        "CAST(r_regionkey * 4 AS DOUBLE) AS min_x",
        "1.0D AS min_y",
        "CAST(r_regionkey * 4 + 6 AS DOUBLE) AS max_x",
        "4.0D AS max_y",
    )


_MAPPINGS = {
    "taxon_group": _taxon_group,
    "taxon": _taxon,
    "taxon_name": _taxon_name,
    "taxon_popular_name": _taxon_popular_name,
    "location": _location,
    "observation": _observation,
    "observation_detail": _observation_detail,
    "observation_behavior": _observation_behavior,
    "observation_tag": _observation_tag,
    "media_file": _media_file,
    "organization": _organization,
    "organization_relation": _organization_relation,
    "area": _area,
    "area_type": _area_type,
    "location_area": _location_area,
    "category_type": _category_type,
    "category": _category,
    "behavior": _behavior,
    "basis_of_record": _basis_of_record,
    "export_job": _export_job,
    "request_log": _request_log,
    "species_response": _species_response,
    "viewport": _viewport,
}
