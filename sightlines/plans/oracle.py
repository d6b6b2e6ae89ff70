"""DuckDB SQL for the named queries, over the raw supplied tables.

Independent of the Spark code: the mapping of the tables is stated again in SQL.
"""

from __future__ import annotations

import re

VIEWS = {
    "f_taxon_group": """
        SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS taxon_group_id, p_brand AS name, FALSE AS is_deleted
        FROM part""",
    "f_taxon": """
        SELECT p_partkey AS taxon_id, p_partkey + 100000 AS external_taxon_id, p_name AS valid_scientific_name,
               p_type AS valid_scientific_name_authorship, concat(p_name, ' ', p_brand) AS preferred_popular_name,
               CAST(substr(p_brand, 7) AS INT) AS taxon_group_id, p_size AS taxon_rank_id,
               CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE CAST(p_size AS INT) END AS cumulative_observation_count,
               p_partkey % 2 = 0 AS exists_in_country, p_partkey % 17 = 0 AS is_deleted
        FROM part""",
    "f_taxon_name": """
        SELECT p_partkey * 2 AS taxon_name_id, p_partkey AS taxon_id, p_name AS scientific_name,
               p_type AS scientific_name_authorship, TRUE AS accepted, FALSE AS is_deleted FROM part
        UNION ALL
        SELECT p_partkey * 2 + 1, p_partkey, concat('syn ', p_name), p_type, FALSE, p_partkey % 5 = 0 FROM part""",
    "f_taxon_popular_name": """
        SELECT p_partkey AS taxon_id, concat(p_name, ' ', p_brand) AS name, p_partkey % 7 = 0 AS is_deleted
        FROM part""",
    "f_location": """
        SELECT c_custkey AS location_id,
               CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 58.0e0 + (c_custkey % 1300) / 100.0e0 END AS latitude,
               5.0e0 + (c_custkey % 2500) / 100.0e0 AS longitude, CAST(floor(c_acctbal * 10) AS INT) AS east,
               CAST(6500000 + c_custkey AS INT) AS north, c_name AS locality,
               CASE c_custkey % 3
                    WHEN 0 THEN concat('POLYGON ((0 0, 0 ', c_custkey, ', 9 ', c_custkey, ', 9 0, 0 0))')
                    WHEN 1 THEN concat('POLYGON ((0 0, 0 ', c_custkey, ', 9 ', c_custkey, ', 0 0))')
                    ELSE concat('POINT (', c_custkey, ' 1)') END AS geometry_wkt
        FROM customer""",
    "f_observation": """
        SELECT o.o_orderkey AS observation_id,
               CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE o.o_custkey END AS location_id,
               p.p_partkey AS taxon_id,
               p.p_partkey * 2 + CASE WHEN o.o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS matched_scientific_name_id,
               CAST(substr(p.p_brand, 7) AS INT) AS taxon_group_id,
               CASE o.o_orderstatus WHEN 'F' THEN 9 WHEN 'O' THEN 11 ELSE NULL END AS category_id,
               CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS basis_of_record_id,
               CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice / 100) AS INT) END
                   AS coordinate_precision_m,
               CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE o.o_orderdate END AS date_time_collected,
               concat('COLL-', o.o_orderpriority) AS collection_code,
               CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE concat('CAT_', o.o_orderkey) END AS catalog_number,
               58.0e0 + (o.o_custkey % 1300) / 100.0e0 AS latitude, o.o_orderkey % 2 = 0 AS has_errors
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey) li
               ON li.l_orderkey = o.o_orderkey
        JOIN part p ON p.p_partkey = coalesce(li.pk, 0)""",
    "f_observation_detail": """
        SELECT o_orderkey AS observation_id, concat('Dataset ', o_orderpriority) AS dataset_name,
               concat('seen "', o_orderstatus, '"; noted') AS notes,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'shore' END AS locality
        FROM orders WHERE o_orderkey % 3 <> 0""",
    "f_observation_behavior": """
        SELECT DISTINCT l_orderkey AS observation_id, l_linenumber AS behavior_id FROM lineitem""",
    "f_observation_tag": """
        SELECT DISTINCT l_orderkey AS observation_id,
               CASE l_returnflag WHEN 'A' THEN 5 WHEN 'R' THEN 6 ELSE 3 END AS tag_id
        FROM lineitem WHERE l_quantity <= 8""",
    "f_media_file": """
        SELECT l_orderkey AS observation_id, l_partkey AS media_file_id
        FROM lineitem WHERE l_linestatus = 'F' AND l_discount >= 0.08""",
    "f_organization": """
        SELECT s_suppkey AS organization_id, s_name AS name, concat('ORG', s_suppkey) AS code,
               CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 3 END AS organization_type_id,
               s_suppkey % 19 = 0 AS is_deleted,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_suppkey AS INT) END AS observation_count
        FROM supplier""",
    "f_organization_relation": """
        SELECT DISTINCT l_orderkey AS observation_id, l_suppkey AS organization_id FROM lineitem""",
    "f_area": """
        SELECT CAST(1000 + n_nationkey AS BIGINT) AS area_id, CAST(100 * (n_regionkey + 1) + n_nationkey AS VARCHAR) AS fid,
               n_name AS name, 1 AS area_type_id, 2 AS zoom_level, CAST(n_regionkey + 1 AS VARCHAR) AS parent_fid,
               n_nationkey <> 24 AS is_current, n_nationkey = 23 AS is_deleted,
               CAST(n_nationkey * 7 AS INT) AS observation_count,
               concat('POLYGON ((', n_nationkey, ' 0, ', n_nationkey, ' 5, ', n_nationkey + 3, ' 5, ',
                      n_nationkey + 3, ' 0, ', n_nationkey, ' 0))') AS wkt_polygon
        FROM nation
        UNION ALL
        SELECT 2000 + r_regionkey, CAST(r_regionkey + 1 AS VARCHAR), r_name, 2, 1, NULL, TRUE, FALSE,
               CAST(r_regionkey * 100 AS INT), NULL FROM region
        UNION ALL
        SELECT 3000 + n_nationkey, concat('Naturbase VV0000', n_nationkey), concat('Reserve ', n_name), 3, 3, NULL,
               TRUE, FALSE, NULL, NULL FROM nation WHERE n_nationkey % 5 = 0
        UNION ALL
        SELECT 4000 + r_regionkey, CAST(91 + r_regionkey AS VARCHAR), concat('Sea ', CASE WHEN r_regionkey = 4 THEN 'AFRICA' ELSE r_name END), 4, 1, NULL, TRUE,
               FALSE, 50, NULL FROM region
        UNION ALL
        SELECT 6000, '21_99', 'Polar islands', 6, 1, NULL, TRUE, FALSE, 5, NULL FROM region WHERE r_regionkey = 0""",
    "f_area_type": """
        SELECT CASE WHEN r_regionkey = 4 THEN 6 ELSE r_regionkey + 1 END AS area_type_id,
               concat('Type ', r_name) AS name FROM region""",
    "f_location_area": """
        SELECT c_custkey AS location_id, 1000 + c_nationkey AS area_id FROM customer
        UNION ALL
        SELECT c_custkey, 2000 + n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
        UNION ALL
        SELECT c_custkey, 3000 + c_nationkey FROM customer WHERE c_nationkey % 5 = 0 AND c_custkey % 3 = 0
        UNION ALL
        SELECT c_custkey, 4000 + n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
        WHERE c_mktsegment = 'BUILDING'
        UNION ALL
        SELECT c_custkey, 6000 FROM customer WHERE c_custkey % 101 = 0""",
    "f_category_type": """
        SELECT r_regionkey AS category_type_id, r_name AS name, r_regionkey = 3 AS is_deleted FROM region
        UNION ALL SELECT 99, 'Empty type', FALSE FROM region WHERE r_regionkey = 0""",
    "f_category": """
        SELECT n_nationkey AS category_id, n_name AS name, n_regionkey AS category_type_id,
               CASE n_nationkey % 5 WHEN 0 THEN 'SE' WHEN 1 THEN 'CR' WHEN 2 THEN 'LC' WHEN 3 THEN 'NE' ELSE 'XX' END
                   AS code,
               n_nationkey * 3 AS observation_count, n_nationkey % 8 = 0 AS is_deleted
        FROM nation""",
    "f_job": """
        SELECT event_id AS job_id, CAST(user_id AS VARCHAR) AS user_id,
               concat(event_type, ' æ/', event_id, '!') AS name,
               CASE event_type WHEN 'view' THEN 'Complete' WHEN 'click' THEN 'Complete' WHEN 'purchase' THEN 'Failed'
                    WHEN 'signup' THEN 'Cancelled' ELSE 'Pending' END AS status,
               CAST(floor(value) AS BIGINT) AS file_size,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('exports/', event_id, '.csv') END AS blob_path,
               ts AS created_at, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS completed_at,
               CASE WHEN event_type = 'view' THEN ts + INTERVAL 10 DAYS END AS expires_at
        FROM events""",
    "f_request_log": """
        SELECT event_id AS request_id, event_type AS endpoint, CAST(floor(value * 10) AS BIGINT) AS elapsed_ms,
               props AS request_body, ts AS occurred_at FROM events""",
    "f_viewport": """
        SELECT r_regionkey AS viewport_id, CAST(r_regionkey * 4 AS DOUBLE) AS min_x, 1.0e0 AS min_y,
               CAST(r_regionkey * 4 + 6 AS DOUBLE) AS max_x, 4.0e0 AS max_y FROM region""",
    "f_entity_areas": """
        SELECT DISTINCT o.observation_id, a.area_type_id AS entity_type_id,
               CASE WHEN a.area_type_id = 3 THEN CAST(replace(a.fid, 'Naturbase VV', '') AS INT)
                    ELSE CAST(replace(a.fid, '_', '') AS INT) END AS entity_id
        FROM f_observation o
        JOIN f_location l ON l.location_id = o.location_id
        JOIN f_location_area la ON la.location_id = l.location_id
        JOIN f_area a ON a.area_id = la.area_id
        WHERE a.is_current""",
    "f_entity_institutions": """
        SELECT DISTINCT r.observation_id, 101 AS entity_type_id, CAST(r.organization_id AS INT) AS entity_id
        FROM f_organization_relation r JOIN f_organization g ON g.organization_id = r.organization_id
        WHERE g.organization_type_id = 1""",
    "f_entity_index": """
        SELECT * FROM f_entity_areas UNION ALL SELECT * FROM f_entity_institutions""",
    "f_attributes": """
        SELECT o.observation_id, o.taxon_group_id, o.category_id, o.basis_of_record_id, o.coordinate_precision_m,
               o.date_time_collected,
               CASE WHEN EXISTS (SELECT 1 FROM f_observation_tag g
                                 WHERE g.observation_id = o.observation_id AND g.tag_id = 6) THEN 3
                    WHEN EXISTS (SELECT 1 FROM f_observation_tag g
                                 WHERE g.observation_id = o.observation_id AND g.tag_id = 5) THEN 2
                    ELSE 1 END AS registration_status_id,
               EXISTS (SELECT 1 FROM f_media_file m WHERE m.observation_id = o.observation_id) AS has_media_files
        FROM f_observation o""",
    "f_enriched_index": """
        SELECT i.observation_id, i.entity_type_id, i.entity_id, coalesce(a.taxon_group_id, 0) AS taxon_group_id,
               a.category_id, coalesce(a.basis_of_record_id, 0) AS basis_of_record_id, a.coordinate_precision_m,
               a.date_time_collected, coalesce(a.registration_status_id, 0) AS registration_status_id,
               coalesce(a.has_media_files, FALSE) AS has_media_files
        FROM f_entity_index i LEFT JOIN f_attributes a ON a.observation_id = i.observation_id""",
    "f_located": """
        SELECT o.location_id, coalesce(l.latitude, 0) AS latitude, coalesce(l.longitude, 0) AS longitude,
               count(*) AS observation_count
        FROM f_observation o JOIN f_location l ON l.location_id = o.location_id
        WHERE o.taxon_group_id BETWEEN 1 AND 15
          AND EXISTS (SELECT 1 FROM f_entity_index i WHERE i.observation_id = o.observation_id AND (
                (i.entity_type_id = 1 AND i.entity_id IN (201, 105)) OR (i.entity_type_id = 2 AND i.entity_id = 3)
                OR (i.entity_type_id = 6 AND i.entity_id = 3)))
        GROUP BY o.location_id, l.latitude, l.longitude
        ORDER BY observation_count DESC, o.location_id LIMIT 500""",
    "f_location_box": """
        SELECT location_id, CAST(0 AS DOUBLE) AS min_x, CAST(0 AS DOUBLE) AS min_y, CAST(9 AS DOUBLE) AS max_x,
               CAST(location_id AS DOUBLE) AS max_y
        FROM f_location WHERE geometry_wkt LIKE 'POLYGON%'""",
    "f_top_polygons": """
        SELECT location_id, count(*) AS observation_count FROM f_observation
        WHERE category_id IN (9, 11) AND location_id IS NOT NULL
        GROUP BY location_id ORDER BY observation_count DESC, location_id LIMIT 900""",
    "f_polygons_all": """
        SELECT l.location_id, l.locality, l.geometry_wkt AS wkt_polygon, t.observation_count
        FROM f_top_polygons t JOIN f_location l ON l.location_id = t.location_id
        WHERE l.geometry_wkt LIKE 'POLYGON%'
          AND length(l.geometry_wkt) - length(replace(l.geometry_wkt, ',', '')) <> 4""",
    "f_marked": """
        SELECT v.viewport_id, a.area_id, a.name, a.fid, a.area_type_id, a.observation_count, a.wkt_polygon,
               n.n_nationkey AS w,
               CASE WHEN greatest(n.n_nationkey, v.min_x) < least(n.n_nationkey + 3, v.max_x)
                    THEN (greatest(n.n_nationkey, v.min_x) + least(n.n_nationkey + 3, v.max_x)) / 2
                    ELSE n.n_nationkey + 1.5e0 END AS marker_x
        FROM f_area a JOIN nation n ON a.area_id = 1000 + n.n_nationkey
        JOIN f_viewport v ON n.n_nationkey <= v.max_x AND n.n_nationkey + 3 >= v.min_x
        WHERE a.is_current""",
    "f_dynamic_counts": """
        SELECT entity_type_id, entity_id, count(*) AS n FROM f_enriched_index
        WHERE taxon_group_id BETWEEN 1 AND 10 AND registration_status_id = 2 AND has_media_files
          AND date_time_collected >= TIMESTAMP '1996-01-01 00:00:00'
          AND date_time_collected <= TIMESTAMP '2000-12-31 23:59:59'
          AND month(date_time_collected) BETWEEN 1 AND 8
        GROUP BY 1, 2""",
    "f_dynamic_area_counts": """
        SELECT a.fid, CAST(sum(c.n) AS BIGINT) AS observation_count
        FROM f_area a JOIN f_dynamic_counts c
          ON c.entity_type_id = a.area_type_id AND c.entity_id = TRY_CAST(replace(a.fid, '_', '') AS INT)
        WHERE a.is_current AND (a.zoom_level = 2 OR a.area_type_id IN (4, 6))
        GROUP BY a.fid""",
}

_FILTERED = "o.observation_id, o.taxon_group_id, o.basis_of_record_id, o.collection_code"


def _filtered(condition: str) -> str:
    return f"SELECT {_FILTERED} FROM f_observation o WHERE {condition}"


def _exists(table: str, condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} x WHERE x.observation_id = o.observation_id AND ({condition}))"


def _tag(condition: str) -> str:
    return _exists("f_observation_tag", condition)


_GEO_OR = _filtered(
    _exists(
        "f_entity_index",
        "(x.entity_type_id = 1 AND x.entity_id IN (201, 302)) OR (x.entity_type_id IN (2, 6) AND x.entity_id IN "
        "(3, 2199)) OR (x.entity_type_id = 3 AND x.entity_id = 5) OR (x.entity_type_id = 4 AND x.entity_id = 94)",
    )
)

_OBSERVATION_ROW = """
    SELECT p.observation_id, t.preferred_popular_name, t.valid_scientific_name AS scientific_name,
           t.valid_scientific_name_authorship AS author,
           (SELECT g.name FROM f_organization g WHERE g.organization_id =
               (SELECT min(i.entity_id) FROM f_entity_institutions i WHERE i.observation_id = p.observation_id))
               AS institution,
           l.locality,
           (SELECT CAST(min(i.entity_id) AS VARCHAR) FROM f_entity_areas i
            WHERE i.observation_id = p.observation_id AND i.entity_type_id = 1) AS municipality_id,
           p.taxon_group_id, p.category_id, p.date_time_collected, p.coordinate_precision_m
    FROM page p JOIN f_taxon t ON t.taxon_id = p.taxon_id LEFT JOIN f_location l ON l.location_id = p.location_id"""

_IN_COUNTIES_1_2 = _exists("f_entity_index", "x.entity_type_id IN (2, 6) AND x.entity_id IN (1, 2)")

_SHOWN_AREAS = "a.is_current AND (a.zoom_level = {zoom} OR a.area_type_id IN (4, 6))"


def _area_counts(counts: str, zoom: int, selection: str = "TRUE") -> str:
    """Area counts from a query giving (entity_type_id, entity_id, n)."""
    return f"""
        SELECT a.fid, CAST(sum(c.n) AS BIGINT) AS observation_count
        FROM f_area a JOIN ({counts}) c
          ON c.entity_type_id = a.area_type_id AND c.entity_id = TRY_CAST(replace(a.fid, '_', '') AS INT)
        WHERE {_SHOWN_AREAS.format(zoom=zoom)} AND ({selection}) GROUP BY a.fid"""


def _index_counts(condition: str) -> str:
    return f"SELECT entity_type_id, entity_id, count(*) AS n FROM f_enriched_index i WHERE {condition} GROUP BY 1, 2"


def _geo(condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM f_entity_index g WHERE g.observation_id = i.observation_id AND ({condition}))"


def _number(column: str) -> str:
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"


_EXPORT_ROWS = """
    SELECT o.observation_id, o.collection_code, o.catalog_number, o.date_time_collected, o.taxon_id, o.latitude,
           o.has_errors, CAST(month(o.date_time_collected) AS INT) AS month_collected,
           CAST(year(o.date_time_collected) AS INT) AS year_collected, d.dataset_name AS detail_dataset_name,
           d.notes AS detail_notes, d.locality AS detail_locality
    FROM f_observation o LEFT JOIN f_observation_detail d ON d.observation_id = o.observation_id
    WHERE o.category_id IN (9, 11)
      AND EXISTS (SELECT 1 FROM f_entity_index x WHERE x.observation_id = o.observation_id
                  AND x.entity_type_id = 2 AND x.entity_id IN (1, 2, 3))"""

_ABBREVIATED = """
    CASE WHEN {n} >= 1000000 THEN concat(regexp_replace(CAST(CAST((CAST({n} AS HUGEINT) + 50000) // 100000 AS DECIMAL(30,0))
              / 10 AS VARCHAR), '\\.0$', ''), 'M')
         WHEN {n} >= 1000 THEN concat(regexp_replace(CAST(CAST((CAST({n} AS HUGEINT) + 50) // 100 AS DECIMAL(30,0))
              / 10 AS VARCHAR), '\\.0$', ''), 'K')
         ELSE CAST({n} AS VARCHAR) END"""

_COUNTY_GROUPS = """
    WITH listed AS (SELECT * FROM f_area WHERE is_current AND NOT is_deleted)
    SELECT c.fid AS county_fid, m.fid AS municipality_fid
    FROM listed c LEFT JOIN listed m
      ON m.area_type_id = 1 AND substr(CASE WHEN length(m.fid) < 4 THEN lpad(m.fid, 4, '0') ELSE m.fid END, 1, 2)
       = CASE WHEN length(c.fid) < 2 THEN lpad(c.fid, 2, '0') ELSE c.fid END
    WHERE c.area_type_id = 2"""

_TAXON_HITS = """
    SELECT t.*, least(
        (SELECT min(CASE WHEN lower(n.scientific_name) = 'red b' THEN 1
                         WHEN starts_with(lower(n.scientific_name), 'red b') THEN 2 ELSE 3 END)
         FROM f_taxon_name n WHERE n.taxon_id = t.taxon_id AND NOT n.is_deleted
           AND contains(lower(n.scientific_name), 'red b')),
        (SELECT min(CASE WHEN lower(n.name) = 'red b' THEN 1
                         WHEN starts_with(lower(n.name), 'red b') THEN 2 ELSE 3 END)
         FROM f_taxon_popular_name n WHERE n.taxon_id = t.taxon_id AND NOT n.is_deleted
           AND contains(lower(n.name), 'red b'))) AS level
    FROM f_taxon t WHERE NOT t.is_deleted AND (t.cumulative_observation_count > 0 OR t.exists_in_country)"""

_EXPORT_COLUMN_DEFAULTS = """
    (0,'Id','Id'),(1,'OccurrenceId','OccurrenceId'),(2,'InstitutionCode','Institusjonskode'),
    (3,'CollectionCode','Samlingskode'),(4,'CatalogNumber','Katalognummer'),
    (5,'DateTimeCollected','Innsamlingsdato'),(6,'TaxonId','Takson-ID'),(7,'Latitude','Breddegrad'),
    (8,'Longitude','Lengdegrad'),(9,'CoordinatePrecisionInMeters','Koordinatpresisjon (meter)'),
    (10,'Detail.DatasetName','Datasett'),(11,'Detail.Collector','Innsamler'),(12,'Detail.Locality','Lokalitet')"""

_SAMPLE_TAXA = """
    SELECT taxon_id, taxon_rank_id, taxon_group_id, exists_in_country FROM (
        SELECT *, row_number() OVER (PARTITION BY taxon_rank_id, taxon_group_id, exists_in_country
                                     ORDER BY taxon_id) AS rn
        FROM f_taxon WHERE NOT is_deleted) WHERE rn <= 2"""
_SAMPLE_OBSERVATIONS = f"""
    SELECT observation_id, category_id, taxon_id, taxon_group_id, location_id FROM (
        SELECT *, row_number() OVER (PARTITION BY category_id, taxon_id, taxon_group_id
                                     ORDER BY observation_id) AS rn
        FROM f_observation
        WHERE taxon_id IN (SELECT taxon_id FROM ({_SAMPLE_TAXA})) AND location_id IS NOT NULL
          AND category_id IS NOT NULL AND taxon_group_id IS NOT NULL) WHERE rn <= 3"""

_FEATURE_PROPERTIES = "concat('{\"id\":', area_id, ',\"name\":\"', name, '\",\"areaTypeId\":', area_type_id"

def _markers(counted: str) -> str:
    """One marker per name from (area_id, name, n): the first area with a polygon describes it."""
    return f"""
        WITH counted AS ({counted}),
             merged AS (SELECT c.name, CAST(sum(c.n) AS BIGINT) AS observation_count, min(c.area_id) AS marker_id,
                               coalesce(min(CASE WHEN a.wkt_polygon IS NOT NULL THEN a.area_id END), min(a.area_id)) AS area_id
                        FROM counted c JOIN f_area a USING (area_id) GROUP BY c.name)
        SELECT m.marker_id, a.fid, m.name, a.area_type_id, a.parent_fid, concat('doc-', a.area_id) AS document_id,
               m.observation_count, a.wkt_polygon
        FROM merged m JOIN f_area a USING (area_id) WHERE m.observation_count > 0"""


QUERIES = {
    "index_areas": "SELECT * FROM f_entity_areas",
    "index_institutions": "SELECT * FROM f_entity_institutions",
    "index_all": "SELECT * FROM f_entity_index",
    "index_enriched": "SELECT * FROM f_enriched_index",
    "index_backfill": "SELECT * FROM f_enriched_index",
    "zoom_levels": "SELECT area_id, area_type_id, zoom_level FROM f_area",
    "f_taxon_group": _filtered("o.taxon_group_id IN (3, 7, 21)"),
    "f_category": _filtered("o.category_id IN (9, 12)"),
    "f_basis": _filtered("o.basis_of_record_id IN (1, 4)"),
    "f_precision": _filtered("o.coordinate_precision_m BETWEEN 500 AND 2500"),
    "f_period": _filtered(
        "o.date_time_collected >= TIMESTAMP '1996-01-01 00:00:00' "
        "AND o.date_time_collected <= TIMESTAMP '1999-12-31 23:59:59'"
    ),
    "f_months": _filtered("month(o.date_time_collected) IN (5, 6, 12)"),
    "f_geo_or": _GEO_OR,
    "f_geo_or_index": _GEO_OR,
    "f_geo_unparsable": _filtered("FALSE"),
    "f_institution": _filtered(_exists("f_entity_index", "x.entity_type_id = 101 AND x.entity_id IN (2, 4, 10)")),
    "f_behavior": _filtered(_exists("f_observation_behavior", "x.behavior_id IN (2, 5)")),
    "f_status_1": _filtered("NOT " + _tag("x.tag_id IN (5, 6)")),
    "f_status_2": _filtered(_tag("x.tag_id = 5")),
    "f_status_3": _filtered(_tag("x.tag_id = 6")),
    "f_media_yes": _filtered(_exists("f_media_file", "TRUE")),
    "f_media_no": _filtered("NOT " + _exists("f_media_file", "TRUE")),
    "f_project_id": _filtered(_exists("f_organization_relation", "x.organization_id = 7")),
    "f_project_name": _filtered(
        _exists(
            "f_organization_relation",
            "x.organization_id IN (SELECT organization_id FROM f_organization "
            "WHERE contains(lower(name), 'r#00000000'))",
        )
    ),
    "f_collection": _filtered("contains(lower(o.collection_code), '2-high')"),
    "f_catalog": _filtered("contains(lower(o.catalog_number), 'cat_12')"),
    "f_like_literal": _filtered("contains(lower(o.catalog_number), 't_1')"),
    "f_text": _filtered(
        "o.taxon_id IN (SELECT taxon_id FROM f_taxon WHERE contains(lower(preferred_popular_name), 'red')) "
        "AND o.matched_scientific_name_id IN (SELECT taxon_name_id FROM f_taxon_name WHERE "
        "contains(lower(scientific_name), 'ring') AND contains(lower(scientific_name_authorship), 'eco'))"
    ),
    "f_envelope": _filtered(
        "o.location_id IN (SELECT location_id FROM f_location WHERE east BETWEEN -500 AND 40000 "
        "AND north BETWEEN 6500000 AND 6500700)"
    ),
    "f_combined_search": _filtered(
        "o.taxon_group_id BETWEEN 1 AND 12 AND o.category_id IN (9, 11) AND "
        + _exists("f_entity_index", "x.entity_type_id IN (2, 6) AND x.entity_id IN (1, 4, 2199)")
        + " AND "
        + _exists("f_entity_index", "x.entity_type_id = 101 AND x.entity_id BETWEEN 2 AND 88")
        + " AND NOT " + _tag("x.tag_id IN (5, 6)")
        + " AND o.date_time_collected >= TIMESTAMP '1996-01-01 00:00:00' AND NOT "
        + _exists("f_media_file", "TRUE")
        + " AND contains(lower(o.collection_code), 'low')"
    ),
    "f_combined_export": _filtered(
        "o.taxon_group_id BETWEEN 1 AND 12 AND o.category_id IN (9, 11) AND "
        + _exists(
            "f_entity_index",
            "(x.entity_type_id = 2 AND x.entity_id IN (1, 4, 2199)) "
            "OR (x.entity_type_id = 101 AND x.entity_id IN (2, 4, 10))",
        )
        + " AND o.date_time_collected >= TIMESTAMP '1996-01-01 00:00:00'"
    ),
    "locations": "SELECT * FROM f_located",
    "locations_envelope": """
        SELECT o.location_id, coalesce(l.latitude, 0) AS latitude, coalesce(l.longitude, 0) AS longitude,
               count(*) AS observation_count
        FROM f_observation o JOIN f_location l ON l.location_id = o.location_id
        WHERE o.category_id IN (9, 11) AND l.east BETWEEN -500 AND 60000 AND l.north BETWEEN 6500000 AND 6501200
        GROUP BY o.location_id, l.latitude, l.longitude
        ORDER BY observation_count DESC, o.location_id LIMIT 100000""",
    "location_lines": f"""
        SELECT location_id, concat('[', location_id, ',', {_number('longitude')}, ',', {_number('latitude')}, ',',
               observation_count, ']') AS line FROM f_located""",
    "location_file": f"""
        SELECT '{{"epsg":25833,"locations":[' AS line UNION ALL SELECT ']}}' UNION ALL
        SELECT concat(CASE WHEN row_number() OVER (ORDER BY observation_count DESC, location_id) > 1 THEN ',' ELSE '' END,
                      '[', location_id, ',', {_number('longitude')}, ',', {_number('latitude')}, ',', observation_count,
                      ']') FROM f_located""",
    "location_document": f"""
        SELECT concat('{{"epsg":25833,"locations":[', string_agg(
            concat('[', location_id, ',', {_number('longitude')}, ',', {_number('latitude')}, ',', observation_count,
                   ']'), ',' ORDER BY observation_count DESC, location_id), ']}}') AS document FROM f_located""",
    "observations_page": f"""
        WITH page AS (SELECT * FROM f_observation o WHERE o.category_id IN (9, 11) AND {_IN_COUNTIES_1_2}
                      ORDER BY o.observation_id LIMIT 200 OFFSET 100) {_OBSERVATION_ROW}""",
    "observations_default": f"""
        WITH page AS (SELECT o.* FROM f_observation o JOIN f_taxon t ON t.taxon_id = o.taxon_id
                      WHERE contains(lower(t.preferred_popular_name), 'blue')
                      ORDER BY o.observation_id LIMIT 20) {_OBSERVATION_ROW}""",
    "observations_deep": """
        SELECT observation_id, taxon_group_id FROM f_observation ORDER BY observation_id LIMIT 80 OFFSET 900""",
    "observations_scattered": """
        WITH far AS (SELECT CASE WHEN observation_id % 5 = 0 THEN observation_id + 1000000000000000
                                 ELSE observation_id END AS observation_id, taxon_group_id FROM f_observation),
             ranked AS (SELECT *, row_number() OVER (ORDER BY observation_id) - 1 AS r, count(*) OVER () AS n FROM far)
        SELECT observation_id, taxon_group_id FROM ranked WHERE r BETWEEN n - n // 5 - 30 AND n - n // 5 + 29""",
    "observations_all": f"""
        WITH page AS (SELECT o.* FROM f_observation o JOIN f_taxon t ON t.taxon_id = o.taxon_id
                      WHERE contains(lower(t.preferred_popular_name), 'blue')) {_OBSERVATION_ROW}""",
    "locations_all": """
        SELECT o.location_id, coalesce(l.latitude, 0) AS latitude, coalesce(l.longitude, 0) AS longitude,
               count(*) AS observation_count
        FROM f_observation o JOIN f_location l ON l.location_id = o.location_id
        WHERE o.taxon_group_id BETWEEN 1 AND 15
          AND EXISTS (SELECT 1 FROM f_entity_index i WHERE i.observation_id = o.observation_id AND (
                (i.entity_type_id = 1 AND i.entity_id IN (201, 105)) OR (i.entity_type_id = 2 AND i.entity_id = 3)
                OR (i.entity_type_id = 6 AND i.entity_id = 3)))
        GROUP BY o.location_id, l.latitude, l.longitude""",
    "observations_after": """
        SELECT observation_id, taxon_group_id FROM f_observation WHERE observation_id > 700
        ORDER BY observation_id LIMIT 200""",
    "page_meta": f"""
        WITH page AS (SELECT o.observation_id FROM f_observation o WHERE {_IN_COUNTIES_1_2}
                      ORDER BY o.observation_id LIMIT 100 OFFSET 25),
             n AS (SELECT count(*) AS n FROM page)
        SELECT 2 AS page_number, 25 AS results_per_page, least(n, 25) AS items,
               CAST(greatest((n + 24) // 25 - 1, 0) AS BIGINT) AS lookahead_count, n >= 100 AS has_more_pages FROM n""",
    "area_counts_pre": f"""
        SELECT fid, CAST(sum(observation_count) AS BIGINT) AS observation_count FROM f_area a
        WHERE {_SHOWN_AREAS.format(zoom=2)} AND (fid = '3' OR parent_fid = '3')
        GROUP BY fid HAVING sum(observation_count) > 0""",
    "area_counts_dynamic": "SELECT fid, observation_count FROM f_dynamic_area_counts",
    "area_counts_subquery": _area_counts(
        _index_counts(
            "coordinate_precision_m <= 4000 AND observation_id IN (SELECT o.observation_id FROM f_observation o WHERE "
            "o.coordinate_precision_m <= 4000 AND " + _exists("f_observation_behavior", "x.behavior_id = 2")
            + ") AND " + _geo("g.entity_type_id IN (2, 6) AND g.entity_id IN (2, 3)")
        ),
        1, "a.fid IN ('2', '3') OR a.parent_fid IN ('2', '3')",
    ),
    "area_counts_geo": _area_counts(
        _index_counts(
            "category_id = 9 AND "
            + _geo("(g.entity_type_id = 3 AND g.entity_id IN (5, 10)) OR (g.entity_type_id = 4 AND g.entity_id = 93)")
        ),
        1, "a.fid = '93'",
    ),
    # "0201" equals no fid, so all areas are shown; as a number it is the municipality 201, where the counts are taken
    "area_counts_fallback": _area_counts(
        _index_counts("taxon_group_id BETWEEN 1 AND 25 AND " + _geo("g.entity_type_id = 1 AND g.entity_id = 201")), 2
    ),
    "area_counts_months": _area_counts(_index_counts("month(date_time_collected) = 5"), 1),
    "area_markers": _markers(
        "SELECT area_id, name, CAST(observation_count AS BIGINT) AS n FROM f_area a "
        f"WHERE {_SHOWN_AREAS.format(zoom=1)}"
    ),
    "area_markers_dynamic": _markers(
        f"""SELECT a.area_id, a.name, coalesce(c.n, 0) AS n FROM f_area a LEFT JOIN
            ({_index_counts("taxon_group_id BETWEEN 1 AND 10 AND basis_of_record_id IN (1, 2)")}) c
            ON c.entity_type_id = a.area_type_id AND c.entity_id = TRY_CAST(replace(a.fid, '_', '') AS INT)
            WHERE {_SHOWN_AREAS.format(zoom=2)}"""
    ),
    "area_rollup": """
        SELECT parent_fid AS fid, CAST(sum(observation_count) AS BIGINT) AS observation_count FROM f_area
        WHERE is_current AND fid IN ('201', '302', '206', '307')
        GROUP BY parent_fid HAVING sum(observation_count) > 0""",
    "area_select": f"""
        SELECT area_id, fid, name FROM f_area a WHERE {_SHOWN_AREAS.format(zoom=1)} AND (
            fid IN ('5', '201', '307', '91') OR parent_fid = '5'
            OR fid IN (SELECT parent_fid FROM f_area WHERE is_current AND area_type_id = 1
                       AND fid IN ('201', '307')))""",
    "area_zero_fill": f"""
        WITH counts AS ({_area_counts(_index_counts("taxon_group_id IN (1, 2) AND " + _geo(
            "(g.entity_type_id = 1 AND g.entity_id = 206) OR (g.entity_type_id IN (2, 6) AND g.entity_id IN (1, 3)) "
            "OR (g.entity_type_id = 4 AND g.entity_id = 92)")), 2,
            "a.fid IN ('1', '3', '206', '92') OR a.parent_fid IN ('1', '3') OR a.fid = '2'")})
        SELECT a.area_id, a.fid, coalesce(c.observation_count, 0) AS observation_count
        FROM f_area a LEFT JOIN counts c ON c.fid = a.fid
        WHERE {_SHOWN_AREAS.format(zoom=2)} AND (a.fid IN ('1', '3', '206', '92') OR a.parent_fid IN ('1', '3'))
          AND (coalesce(c.observation_count, 0) > 0 OR a.fid IN ('1', '3', '206', '92'))""",
    "area_ocean_append": """
        SELECT area_id, fid, area_type_id FROM f_area
        WHERE is_current AND (zoom_level = 3 OR fid IN ('91', '95'))""",
    "hierarchy": "SELECT DISTINCT fid, area_type_id, parent_fid FROM f_area WHERE is_current",
    "hierarchy_lists": """
        SELECT parent_fid AS county_fid, string_agg(fid, ',' ORDER BY fid) AS municipality_fids
        FROM f_area WHERE is_current AND area_type_id = 1 GROUP BY parent_fid""",
    "hierarchy_prefix": _COUNTY_GROUPS,
    "area_collapse": """
        WITH m AS (SELECT parent_fid, concat(parent_fid, substr(fid, 2, 2)) AS fid FROM f_area
                   WHERE area_type_id = 1 AND is_current AND NOT is_deleted),
             s AS (SELECT parent_fid, count(*) AS members, count(*) FILTER (fid IN
                       ('201', '206', '211', '216', '221', '302', '307')) AS chosen FROM m GROUP BY parent_fid)
        SELECT 'county' AS level, parent_fid AS fid FROM s WHERE members = chosen
        UNION
        SELECT 'municipality', m.fid FROM m JOIN s ON s.parent_fid = m.parent_fid
        WHERE s.members <> s.chosen AND m.fid IN ('201', '206', '211', '216', '221', '302', '307')
        UNION
        SELECT 'county', '21_99'""",
    "taxon_search": f"""
        SELECT taxon_id, external_taxon_id, valid_scientific_name, valid_scientific_name_authorship,
               preferred_popular_name, taxon_group_id, taxon_rank_id, cumulative_observation_count, exists_in_country
        FROM ({_TAXON_HITS}) WHERE level IS NOT NULL ORDER BY level, taxon_id LIMIT 40""",
    "taxon_union": f"SELECT taxon_id, preferred_popular_name FROM ({_TAXON_HITS}) WHERE level IS NOT NULL",
    "lookup_categories": """
        SELECT t.category_type_id, t.name AS type_name, coalesce(string_agg(
                   concat_ws(':', c.name, c.category_id, c.code, c.observation_count), '|'
                   ORDER BY c.name, c.category_id), '') AS categories
        FROM f_category_type t LEFT JOIN (SELECT * FROM f_category WHERE NOT is_deleted) c
          ON c.category_type_id = t.category_type_id
        WHERE NOT t.is_deleted GROUP BY t.category_type_id, t.name""",
    "lookup_category_rows": """
        SELECT t.category_type_id, t.name AS type_name, c.name AS category_name, c.code
        FROM f_category_type t LEFT JOIN (SELECT * FROM f_category WHERE NOT is_deleted) c
          ON c.category_type_id = t.category_type_id WHERE NOT t.is_deleted""",
    "lookup_areas": """
        SELECT t.area_type_id, t.name AS type_name, coalesce(string_agg(
                   concat_ws(':', a.name, a.area_id, a.fid), '|' ORDER BY a.name, a.area_id), '') AS areas
        FROM f_area_type t LEFT JOIN (SELECT * FROM f_area WHERE is_current AND NOT is_deleted) a
          ON a.area_type_id = t.area_type_id GROUP BY t.area_type_id, t.name""",
    "lookup_area_rows": """
        SELECT t.area_type_id, t.name AS type_name, a.name AS area_name, a.fid
        FROM f_area_type t LEFT JOIN (SELECT * FROM f_area WHERE is_current AND NOT is_deleted) a
          ON a.area_type_id = t.area_type_id""",
    "area_slots": "SELECT " + ", ".join(
        f"(SELECT name FROM f_area_type WHERE area_type_id = {k}) AS {n}_type, "
        f"(SELECT CAST(count(*) AS INT) FROM f_area WHERE is_current AND NOT is_deleted AND area_type_id = {k}) "
        f"AS {n}_size"
        for n, k in (("counties", 2), ("municipalities", 1), ("restricted_areas", 3), ("ocean_areas", 4),
                     ("polar_islands", 6))
    ),
    "institutions": """
        SELECT organization_id, name, code, observation_count FROM f_organization
        WHERE NOT is_deleted AND organization_type_id = 1 AND observation_count > 0""",
    "org_search": """
        SELECT organization_id, name FROM f_organization
        WHERE NOT is_deleted AND contains(lower(name), 'supplier#0000000')
        ORDER BY name, organization_id LIMIT 30""",
    "taxon_groups": "SELECT taxon_group_id, name FROM f_taxon_group WHERE NOT is_deleted",
    "behaviors": """
        SELECT l_linenumber AS behavior_id, concat('behaviour ', l_linenumber) AS name,
               concat('b', l_linenumber, ',Behaviour ', l_linenumber, ',bhv', l_linenumber) AS variants,
               CAST(count(*) AS INT) AS observation_count
        FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY l_linenumber""",
    "basis_of_records": """
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS basis_of_record_id, o_orderpriority AS name,
               o_orderpriority AS variants, concat('Basis ', o_orderpriority) AS description FROM orders
        UNION ALL SELECT 16, 'dna', 'dna,DNA', 'DNA'
        UNION ALL SELECT 17, 'edna', 'edna,eDNA,environmental dna,environmental DNA', 'eDNA'
        UNION ALL SELECT 18, 'edna_barcoding', 'edna_barcoding,eDNA Barcoding,eDAN Barcoding', 'eDNA Barcoding'""",
    "variant_lists": """
        SELECT DISTINCT l_linenumber AS behavior_id,
               concat('Behaviour ', l_linenumber, ',b', l_linenumber, ',bhv', l_linenumber) AS variants
        FROM lineitem""",
    "category_order": """
        SELECT category_id, code, name,
               CASE code WHEN 'SE' THEN 1 WHEN 'CR' THEN 8 WHEN 'LC' THEN 13 WHEN 'NE' THEN 15 ELSE 16 END
                   AS display_rank
        FROM f_category WHERE NOT is_deleted""",
    "export_rows": _EXPORT_ROWS,
    "export_lines": f"""
        SELECT observation_id, concat(observation_id, ';', collection_code, ';', coalesce(catalog_number, ''), ';',
               coalesce(strftime(date_time_collected, '%Y-%m-%d %H:%M:%S'), ''), ';', taxon_id, ';',
               {_number('latitude')}, ';', CASE WHEN has_errors THEN '1' ELSE '0' END, ';',
               coalesce(CAST(month_collected AS VARCHAR), ''), ';', coalesce(CAST(year_collected AS VARCHAR), ''), ';',
               coalesce(detail_dataset_name, ''), ';',
               coalesce(concat('"', replace(detail_notes, '"', '""'), '"'), ''), ';',
               coalesce(detail_locality, '')) AS line
        FROM (SELECT *, detail_notes IS NULL AS no_notes FROM ({_EXPORT_ROWS})) WHERE NOT no_notes
        UNION ALL
        SELECT observation_id, concat(observation_id, ';', collection_code, ';', coalesce(catalog_number, ''), ';',
               coalesce(strftime(date_time_collected, '%Y-%m-%d %H:%M:%S'), ''), ';', taxon_id, ';',
               {_number('latitude')}, ';', CASE WHEN has_errors THEN '1' ELSE '0' END, ';',
               coalesce(CAST(month_collected AS VARCHAR), ''), ';', coalesce(CAST(year_collected AS VARCHAR), ''),
               ';;;')
        FROM ({_EXPORT_ROWS}) WHERE detail_notes IS NULL""",
    "export_summary": f"""
        WITH n AS (SELECT count(*) AS n FROM f_observation o WHERE o.category_id IN (9, 11) AND
                   {_exists("f_entity_index", "x.entity_type_id = 101 AND x.entity_id IN (2, 4, 10)")})
        SELECT n AS total_rows, CAST(floor(n * (500 * (CAST(13 AS DOUBLE) / 49) + 14)) AS BIGINT) AS estimated_bytes,
               n > 1000 AS exceeds_soft_limit, n > 100000 AS exceeds_hard_limit,
               'Mine-funn-blåmeis_2024' AS export_name FROM n""",
    "export_limit": f"SELECT count(*) > 2000 AS exceeds_limit FROM ({_EXPORT_ROWS})",
    "export_jobs": """
        SELECT event_id AS job_id, CAST(event_id % 25 + 1 AS VARCHAR) AS taxon_groups,
               CAST(event_id % 5 + 1 AS VARCHAR) AS counties, CAST(1995 + event_id % 4 AS INT) AS period_from,
               '5,6' AS months, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END AS column_count FROM events""",
    "export_job_columns": f"""
        SELECT event_id AS job_id, d.position, d.name AS "column", d.header
        FROM events CROSS JOIN (VALUES {_EXPORT_COLUMN_DEFAULTS}) d(position, name, header) WHERE event_id % 3 <> 0
        UNION ALL SELECT event_id, 0, 'Id', 'Id' FROM events WHERE event_id % 3 = 0
        UNION ALL SELECT event_id, 1, 'Detail.Notes', 'Merknader' FROM events WHERE event_id % 3 = 0""",
    "slug": "SELECT event_id AS job_id, concat(event_type, '-æ', event_id) AS slug FROM events",
    "sample_taxa": _SAMPLE_TAXA,
    "sample_observations": f"""
        SELECT observation_id, category_id, taxon_id, taxon_group_id FROM ({_SAMPLE_OBSERVATIONS})""",
    "sample_locations": f"SELECT DISTINCT location_id FROM ({_SAMPLE_OBSERVATIONS})",
    "polygons": """
        WITH top AS (SELECT o.location_id, count(*) AS observation_count
                     FROM f_observation o JOIN f_location l ON l.location_id = o.location_id
                     WHERE o.taxon_group_id BETWEEN 1 AND 15 AND l.east BETWEEN 5 AND 60000
                       AND l.north BETWEEN 40 AND 6500900
                     GROUP BY o.location_id ORDER BY observation_count DESC, o.location_id LIMIT 300)
        SELECT l.location_id, l.locality, l.geometry_wkt AS wkt_polygon, t.observation_count
        FROM top t JOIN f_location l ON l.location_id = t.location_id
        JOIN f_location_box b ON b.location_id = l.location_id
        WHERE length(l.geometry_wkt) - length(replace(l.geometry_wkt, ',', '')) <> 4
          AND NOT (b.max_x < 5.5 OR b.min_x > 60000.0 OR b.max_y < 40.0 OR b.min_y > 6500900.0)""",
    "polygons_all": "SELECT * FROM f_polygons_all",
    "wkt_bbox": "SELECT * FROM f_location_box",
    "bbox_overlap": """
        SELECT b.location_id, v.viewport_id FROM f_location_box b JOIN f_viewport v
          ON b.min_x <= v.max_x AND b.max_x >= v.min_x AND b.min_y <= v.max_y AND b.max_y >= v.min_y""",
    "area_centroids": """
        SELECT a.area_id, n.n_nationkey + 1.5e0 AS centroid_x, CASE WHEN n.n_nationkey IS NULL THEN NULL ELSE 2.5e0 END
                   AS centroid_y
        FROM f_area a LEFT JOIN nation n ON a.area_id = 1000 + n.n_nationkey""",
    "viewport_markers": """
        SELECT viewport_id, area_id, FALSE AS fully_visible, marker_x, 2.5e0 AS marker_y FROM f_marked""",
    "geojson_features": f"""
        SELECT viewport_id, area_id, 'outline' AS kind, concat('{{"type":"Feature","geometry":{{"type":"Polygon",',
               '"coordinates":[[[', w, ',0],[', w, ',5],[', w + 3, ',5],[', w + 3, ',0],[', w, ',0]]]}},"properties":',
               {_FEATURE_PROPERTIES}, ',"fid":"', fid, '"}}'), '}}') AS feature FROM f_marked
        UNION ALL
        SELECT viewport_id, area_id, 'marker', concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[',
               {_number('marker_x')}, ',2.5]}},"properties":', {_FEATURE_PROPERTIES}, ',"observationCount":',
               observation_count, ',"fid":"', fid, '","label":"', observation_count, '"}}'), '}}') FROM f_marked""",
    "geojson_locations": f"""
        SELECT location_id, concat('{{"type":"Feature","id":', location_id, ',"geometry":{{"type":"Point",',
               '"coordinates":[', {_number('longitude')}, ',', {_number('latitude')}, ']}},"properties":{{"id":',
               location_id, ',"name":"Location ', location_id, '","observationCount":', observation_count,
               ',"observationCountDisplay":"', {_ABBREVIATED.format(n='observation_count')},
               '","isPolygon":false}}}}') AS feature
        FROM f_located""",
    "geojson_polygons": f"""
        SELECT location_id, concat('{{"type":"Feature","id":', location_id, ',"geometry":{{"type":"Polygon",',
               '"coordinates":[[[0,0],[0,', location_id, '],[9,', location_id, '],[0,0]]]}},"properties":{{"id":',
               location_id, ',"name":"', locality, '","observationCount":', observation_count,
               ',"observationCountDisplay":"', {_ABBREVIATED.format(n='observation_count')},
               '","isPolygon":true}}}}') AS feature
        FROM f_polygons_all""",
    "geojson_overlays": """
        SELECT a.area_id, concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[', n_nationkey,
               ',0],[', n_nationkey, ',5],[', n_nationkey + 3, ',5],[', n_nationkey + 3, ',0],[', n_nationkey,
               ',0]]]},"properties":{"id":', a.area_id, ',"name":"', a.name, '","fid":"', a.fid, '"}}') AS feature
        FROM f_area a JOIN nation ON a.area_id = 1000 + n_nationkey WHERE a.fid IN ('201', '307', '5')""",
    "species_normalised": """
        SELECT p_partkey AS response_id, CAST(p_partkey AS INT) AS taxon_id, p_name AS scientific_name,
               concat('<i>', p_name, '</i>') AS scientific_name_formatted, p_type AS author, 'species' AS rank,
               concat(p_brand, ':nb') AS preferred_names, concat(p_brand, ' two:nn') AS other_names,
               concat(p_name, ':<i>', p_name, '</i>:', p_type, ':species') AS synonyms
        FROM part WHERE p_partkey % 2 = 0
        UNION ALL
        SELECT p_partkey, CAST(p_partkey AS INT), p_name, concat('<i>', p_name, '</i>'), p_type, 'species',
               concat(p_brand, ':nb'), concat(p_brand, ' two:nb'),
               concat('syn ', p_name, ':<i>syn ', p_name, '</i>:', p_type, ':species')
        FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 7 <> 0
        UNION ALL
        SELECT p_partkey, CAST(p_partkey AS INT), NULL, NULL, NULL, NULL, '', '', ''
        FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 7 = 0""",
    "fingerprint": """
        SELECT concat('"', md5(concat('[', string_agg(concat('{"Fid":"', fid, '","ObservationCount":',
               observation_count, '}'), ',' ORDER BY fid), ']')), '"') AS etag FROM f_dynamic_area_counts""",
    "history": """
        SELECT job_id, user_id, status, file_size FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id DESC) AS rn FROM f_job)
        WHERE rn <= 50""",
    "history_one_user": """
        SELECT job_id, user_id, status, file_size FROM f_job WHERE user_id = '7'
        ORDER BY created_at DESC, job_id DESC LIMIT 50""",
    "expired_jobs": """
        SELECT job_id, status, CAST(0 AS BIGINT) AS file_size FROM f_job
        WHERE (status = 'Complete' AND expires_at < TIMESTAMP '2024-01-25 12:00:00')
           OR (status IN ('Failed', 'Cancelled') AND blob_path IS NOT NULL
               AND completed_at < TIMESTAMP '2024-01-24 12:00:00')""",
    "slow_log": """
        SELECT request_id, endpoint, elapsed_ms AS query_time_ms, CAST(1000 AS BIGINT) AS threshold_ms,
               substr(request_body, 1, 4000) AS request_body, occurred_at
        FROM f_request_log WHERE elapsed_ms >= 1000""",
    "abbrev": f"""
        SELECT request_id, {_ABBREVIATED.format(n='(elapsed_ms * request_id)')} AS shown FROM f_request_log""",
    "zoom_buckets": """
        SELECT request_id, CASE WHEN elapsed_ms / 100.0e0 >= 11 THEN 3 WHEN elapsed_ms / 100.0e0 >= 9 THEN 2 ELSE 1 END
                   AS zoom_level FROM f_request_log""",
}

_VIEW_NAME = re.compile(r"\bf_[a-z_]+\b")


def _needed(sql: str, found: dict[str, None]) -> dict[str, None]:
    """Views a statement reads, each after the views it reads itself."""
    for name in _VIEW_NAME.findall(sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found[name] = None
    return found


QUERIES["area_counts_compat"] = f"SELECT fid, observation_count FROM ({QUERIES['area_markers']})"
QUERIES["stored_index"] = QUERIES["index_enriched"]
QUERIES["stored_lines"] = f"SELECT line FROM ({QUERIES['location_lines']})"
QUERIES["text_catalog"] = QUERIES["f_catalog"]
QUERIES["text_literal"] = QUERIES["f_like_literal"]
QUERIES["text_collection"] = QUERIES["f_collection"]
QUERIES["text_short"] = _filtered("contains(lower(o.collection_code), '-h')")
QUERIES["text_project"] = QUERIES["f_project_name"]
QUERIES["text_names"] = QUERIES["f_text"]
QUERIES["text_taxa"] = QUERIES["taxon_search"]
QUERIES["text_organizations"] = QUERIES["org_search"]
QUERIES["text_postings"] = """
    SELECT DISTINCT substr(concat(lower(preferred_popular_name), '$$'), i, 3) AS piece, taxon_id
    FROM (SELECT *, unnest(range(1, length(preferred_popular_name) + 1)) AS i FROM f_taxon)"""
QUERIES["bitmap_geo_or"] = QUERIES["f_geo_or"]
QUERIES["bitmap_combined_search"] = QUERIES["f_combined_search"]
QUERIES["bitmap_combined_export"] = QUERIES["f_combined_export"]
QUERIES["bitmap_export_count"] = f"SELECT count(*) AS n FROM ({QUERIES['f_combined_export']})"
QUERIES["bitmap_ids"] = f"SELECT observation_id FROM ({QUERIES['f_status_2']})"
QUERIES["bitmap_area_counts"] = QUERIES["area_counts_dynamic"]
QUERIES["bitmap_area_counts_geo"] = QUERIES["area_counts_geo"]
QUERIES["cube_area_counts"] = QUERIES["area_counts_dynamic"]
QUERIES["cube_area_markers"] = QUERIES["area_markers_dynamic"]
QUERIES["cube_area_months"] = QUERIES["area_counts_months"]
_YEAR_MONTH = """100 * (2 * year(date_time_collected) + CASE WHEN date_time_collected
    > make_timestamp(year(date_time_collected), 12, 31, 23, 59, 59.0) THEN 1 ELSE 0 END) + month(date_time_collected)"""
QUERIES["cube_cells"] = " UNION ALL ".join(
    f"""SELECT {number} AS cuboid, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT count(*) AS n FROM f_enriched_index GROUP BY entity_type_id, entity_id{''.join(", " + d for d in dimensions)})"""
    for number, dimensions in enumerate(
        (
            ("taxon_group_id", "category_id", "basis_of_record_id", "registration_status_id", "has_media_files", _YEAR_MONTH),
            ("taxon_group_id",), ("category_id",), ("basis_of_record_id",), ("registration_status_id", "has_media_files"),
            (_YEAR_MONTH,), ("taxon_group_id", "category_id"), ("taxon_group_id", "basis_of_record_id"),
            ("taxon_group_id", _YEAR_MONTH), ("taxon_group_id", "category_id", "registration_status_id", "has_media_files"),
        )
    )
)
QUERIES["cube_merged"] = """
    SELECT entity_type_id, entity_id, taxon_group_id, category_id, count(*) AS n FROM f_enriched_index
    WHERE observation_id % 7 <> 0 GROUP BY ALL"""
_PAGE = "SELECT o.observation_id FROM f_observation o WHERE {} ORDER BY o.observation_id LIMIT {} OFFSET {}"
_ANY_AREA = _exists(
    "f_entity_index",
    "(x.entity_type_id IN (2, 6) AND x.entity_id IN (1, 2)) OR (x.entity_type_id = 4 AND x.entity_id = 93)",
)
QUERIES["pages_any_area"] = _PAGE.format(_ANY_AREA, 20, 145)
QUERIES["pages_one_area"] = _PAGE.format(_exists("f_entity_index", "x.entity_type_id = 1 AND x.entity_id = 201"), 8, 16)
QUERIES["pages_unfiltered"] = _PAGE.format("TRUE", 40, 990)
QUERIES["pages_parts"] = _PAGE.format("o.category_id = 9 AND NOT " + _exists("f_media_file", "TRUE"), 8, 98)
QUERIES["pages_behind"] = _PAGE.format("FALSE", 1, 0)
QUERIES["pages_rows"] = f"""
    WITH page AS (SELECT * FROM f_observation WHERE observation_id IN ({QUERIES["pages_any_area"]})) {_OBSERVATION_ROW}"""
QUERIES["backfill_resumed"] = QUERIES["index_enriched"]
QUERIES["index_changed"] = QUERIES["index_enriched"]
QUERIES["z_locations_envelope"] = QUERIES["locations_envelope"]
QUERIES["z_polygons"] = QUERIES["polygons"]
QUERIES["z_envelope"] = QUERIES["f_envelope"]
_PLACES = """
    places AS (
        SELECT 'all' AS node, NULL AS parent
        UNION ALL SELECT concat('c', fid), 'all' FROM f_area WHERE is_current AND area_type_id = 2
        UNION ALL SELECT concat('m', fid), concat('c', parent_fid) FROM f_area WHERE is_current AND area_type_id = 1
        UNION ALL SELECT concat('l', la.location_id), concat('m', a.fid) FROM f_location_area la
        JOIN f_area a ON a.area_id = la.area_id WHERE a.is_current AND a.area_type_id = 1),
    paths AS (
        SELECT node, [node] AS path FROM places p WHERE NOT EXISTS (SELECT 1 FROM places q WHERE q.node = p.parent)
        UNION ALL SELECT p.node, list_append(paths.path, p.node) FROM places p JOIN paths ON p.parent = paths.node)"""
QUERIES["tree_closure"] = """
    WITH RECURSIVE nodes AS (SELECT fid AS node, parent_fid AS parent FROM f_area WHERE is_current AND area_type_id IN (1, 2)),
    pairs AS (
        SELECT node AS ancestor, node AS descendant, CAST(0 AS BIGINT) AS distance FROM nodes
        UNION ALL
        SELECT u.node, p.descendant, p.distance + 1 FROM pairs p JOIN nodes n ON n.node = p.ancestor
        JOIN nodes u ON u.node = n.parent)
    SELECT * FROM pairs"""
QUERIES["tree_labels"] = f"""
    WITH RECURSIVE {_PLACES},
    sizes AS (SELECT unnest(path) AS node, 1 AS one FROM paths),
    totals AS (SELECT node, count(*) AS size FROM sizes GROUP BY node),
    placed AS (SELECT node, row_number() OVER (ORDER BY path) - 1 AS first FROM paths)
    SELECT node, first, first + size - 1 AS last FROM placed JOIN totals USING (node)"""
QUERIES["tree_rollup"] = f"""
    WITH RECURSIVE {_PLACES},
    counted AS (SELECT concat('l', location_id) AS node, count(*) AS n FROM f_observation WHERE location_id IS NOT NULL GROUP BY 1),
    below AS (SELECT unnest(path) AS node, n FROM paths JOIN counted USING (node))
    SELECT node, CAST(sum(n) AS BIGINT) AS n FROM below GROUP BY node"""
QUERIES["digest_changes"] = f"""
    WITH RECURSIVE {_PLACES},
    below AS (
        SELECT unnest(path) AS node, observation_id % 997 = 5 OR observation_id % 499 = 7 AS differs,
               observation_id % 499 <> 7 AS stays
        FROM paths JOIN f_observation o ON paths.node = concat('l', o.location_id))
    SELECT node, CASE WHEN bool_or(stays) THEN 'changed' ELSE 'removed' END AS change
    FROM below GROUP BY node HAVING bool_or(differs)"""
QUERIES["request_verdicts"] = """
    WITH asked AS (
        SELECT request_id, request_id % 4 AS kind, elapsed_ms % 1200 AS items, elapsed_ms % 7 - 1 AS pf,
               request_id % 5 AS pt, CASE WHEN request_id % 3 = 0 THEN NULL ELSE elapsed_ms % 9 - 1 END AS page,
               CASE WHEN request_id % 11 = 0 THEN NULL ELSE elapsed_ms % 12000 END AS per_page, elapsed_ms % 4 AS zoom,
               elapsed_ms * 13 % 110000 AS most, elapsed_ms % 10 AS x,
               CASE WHEN request_id % 2 = 0 THEN NULL ELSE elapsed_ms % 3 END AS y
        FROM f_request_log),
    broken AS (
        SELECT request_id, concat_ws(',',
            CASE WHEN kind = 3 AND (x >= 5 OR y <= 0) THEN 'envelope' END,
            CASE WHEN items > 500 THEN 'list_items' END,
            CASE WHEN kind = 3 AND (most < 1 OR most > 100000) THEN 'max_results' END,
            CASE WHEN kind = 1 AND page <= 0 THEN 'page_number' END,
            CASE WHEN kind = 1 AND (page IS NULL AND per_page IS NOT NULL OR page IS NOT NULL AND per_page IS NULL)
                 THEN 'page_together' END,
            CASE WHEN pf > 0 AND pt > 0 AND pf > pt THEN 'precision_order' END,
            CASE WHEN kind = 1 AND (per_page < 1 OR per_page > 10000) THEN 'results_per_page' END,
            CASE WHEN kind = 2 AND zoom NOT IN (1, 2) THEN 'zoom_level' END) AS rules
        FROM asked)
    SELECT request_id, rules = '' AS accepted, rules FROM broken"""
QUERIES["latency_quantiles"] = """
    WITH celled AS (
        SELECT date_trunc('hour', occurred_at) AS started_at, endpoint,
               CASE WHEN elapsed_ms < 8 THEN greatest(elapsed_ms, 0)
                    ELSE (elapsed_ms >> (length(bin(elapsed_ms)) - 4)) << (length(bin(elapsed_ms)) - 4) END AS least
        FROM f_request_log WHERE occurred_at IS NOT NULL AND elapsed_ms IS NOT NULL),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY started_at, endpoint ORDER BY least) AS place,
               count(*) OVER (PARTITION BY started_at, endpoint) AS total FROM celled)
    SELECT started_at, endpoint, count(*) AS n, min(least) FILTER (100 * place >= 50 * total) AS p50,
           min(least) FILTER (100 * place >= 90 * total) AS p90, min(least) FILTER (100 * place >= 99 * total) AS p99
    FROM placed GROUP BY started_at, endpoint"""
QUERIES["observations_colocated"] = QUERIES["observations_all"]
QUERIES["viewport_spread"] = """
    WITH views AS (
        SELECT viewport_id, min_x - 1.5e0 AS min_x, viewport_id - 2.0e0 AS min_y, max_x + viewport_id AS max_x,
               viewport_id * 2 + 2.5e0 AS max_y FROM f_viewport),
    met AS (
        SELECT v.*, a.area_id, n.n_nationkey AS w,
               min_x <= w AND max_x >= w + 3 AND min_y <= 0 AND max_y >= 5 AS fully_visible,
               greatest(w, min_x) AS x1, least(w + 3, max_x) AS x2, greatest(0, min_y) AS y1, least(5, max_y) AS y2
        FROM f_area a JOIN nation n ON a.area_id = 1000 + n.n_nationkey
        JOIN views v ON n.n_nationkey <= v.max_x AND n.n_nationkey + 3 >= v.min_x AND v.max_y >= 0 AND v.min_y <= 5
        WHERE a.is_current)
    SELECT viewport_id, area_id, fully_visible,
           CASE WHEN fully_visible OR x1 >= x2 OR y1 >= y2 THEN w + 1.5e0 ELSE (x1 + x2) / 2 END AS marker_x,
           CASE WHEN fully_visible OR x1 >= x2 OR y1 >= y2 THEN 2.5e0 ELSE (y1 + y2) / 2 END AS marker_y
    FROM met"""
QUERIES["area_slot_members"] = """
    SELECT s.slot, t.name AS type_name,
           CAST(row_number() OVER (PARTITION BY s.slot ORDER BY a.name, a.area_id) - 1 AS INT) AS place,
           a.area_id, a.fid, a.name, a.observation_count
    FROM (VALUES ('counties', 2), ('municipalities', 1), ('restricted_areas', 3), ('ocean_areas', 4), ('polar_islands', 6))
         s(slot, kind)
    JOIN f_area_type t ON t.area_type_id = s.kind
    JOIN f_area a ON a.area_type_id = s.kind AND a.is_current AND NOT a.is_deleted"""
QUERIES["stored_csv"] = f"SELECT observation_id, collection_code FROM ({_EXPORT_ROWS})"


def with_views(sql: str) -> str:
    """The statement with the views it needs as common table expressions."""
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _needed(sql, {}))
    return f"WITH {views}\nSELECT * FROM (\n{sql}\n)" if views else sql


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in QUERIES.items()}
