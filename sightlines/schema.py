"""Explicit schemas; nothing in this library infers a schema from data."""

from __future__ import annotations

# The supplied benchmark tables that carry occurrence data after mapping.
SUPPLIED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_DETAIL_TEXT = (
    "dataset_name", "dataset_id", "collector", "individual_count", "notes", "identified_by", "locality",
    "habitat", "sex", "collecting_method", "record_number", "field_number", "measurement_method",
    "georeference_remarks", "preparations", "other_catalog_numbers", "type_status", "event_time",
    "verbatim_depth", "dynamic_properties", "associated_references",
)

# The occurrence schema. Geometry is WKT text, coordinates are doubles.
OCCURRENCE = {
    "observation": (
        "observation_id bigint, proxy_id string, occurrence_id string, node_id int, institution_code string, "
        "collection_code string, catalog_number string, basis_of_record_id int, "
        "date_time_collected timestamp_ntz, datetime_identified timestamp_ntz, "
        "date_last_modified timestamp_ntz, date_time_record_imported timestamp_ntz, taxon_id bigint, "
        "matched_scientific_name_id bigint, taxon_group_id int, category_id int, latitude double, "
        "longitude double, east int, north int, coordinate_precision_m int, location_id bigint, "
        "has_errors boolean, has_annotations boolean, observation_quality_type_id int"
    ),
    "observation_detail": (
        "observation_id bigint, "
        + ", ".join(f"{c} string" for c in _DETAIL_TEXT)
        + ", maximum_elevation_m int, minimum_elevation_m int"
    ),
    "observation_behavior": "observation_id bigint, behavior_id int",
    "observation_tag": "observation_id bigint, tag_id int",
    "media_file": "media_file_id bigint, observation_id bigint",
    "location": (
        "location_id bigint, latitude double, longitude double, east int, north int, locality string, "
        "geometry_wkt string"
    ),
    "location_area": "location_id bigint, area_id bigint",
    "area": (
        "area_id bigint, fid string, name string, area_type_id int, zoom_level int, parent_fid string, "
        "is_current boolean, is_deleted boolean, observation_count int, wkt_polygon string, document_id string, "
        "centroid_x double, centroid_y double"
    ),
    "area_type": "area_type_id int, name string, is_deleted boolean",
    "taxon": (
        "taxon_id bigint, external_taxon_id bigint, valid_scientific_name string, "
        "valid_scientific_name_authorship string, preferred_popular_name string, taxon_group_id int, "
        "taxon_rank_id int, cumulative_observation_count int, exists_in_country boolean, is_deleted boolean"
    ),
    "taxon_name": (
        "taxon_name_id bigint, taxon_id bigint, scientific_name string, scientific_name_authorship string, "
        "accepted boolean, is_deleted boolean"
    ),
    "taxon_popular_name": (
        "taxon_popular_name_id bigint, taxon_id bigint, name string, language string, preferred boolean, "
        "is_deleted boolean"
    ),
    "taxon_group": "taxon_group_id int, name string, observation_count int, is_deleted boolean",
    "organization": (
        "organization_id bigint, name string, code string, organization_type_id int, observation_count int, "
        "is_deleted boolean"
    ),
    "organization_relation": "observation_id bigint, organization_id bigint",
    "category_type": "category_type_id int, name string, is_deleted boolean",
    "category": (
        "category_id int, code string, name string, category_type_id int, observation_count int, "
        "is_deleted boolean"
    ),
    "behavior": (
        "behavior_id int, name string, variants string, description string, observation_count int, "
        "is_deleted boolean"
    ),
    "basis_of_record": (
        "basis_of_record_id int, name string, description string, variants string, observation_count int, "
        "is_deleted boolean"
    ),
    "entity_index": (
        "observation_id bigint, entity_id int, taxon_group_id int, category_id int, basis_of_record_id int, "
        "coordinate_precision_m int, date_time_collected timestamp_ntz, registration_status_id int, "
        "has_media_files boolean, entity_type_id int"
    ),
    "export_job": (
        "job_id bigint, user_id string, name string, status string, filter_json string, "
        "selected_columns string, file_size bigint, blob_path string, excel_blob_path string, "
        "created_at timestamp_ntz, completed_at timestamp_ntz, expires_at timestamp_ntz"
    ),
    "request_log": (
        "request_id bigint, endpoint string, elapsed_ms bigint, request_body string, occurred_at timestamp_ntz"
    ),
    "species_response": "response_id bigint, shape string, body string",
    "viewport": "viewport_id int, min_x double, min_y double, max_x double, max_y double",
}

# Stored export filter: the JSON document of a job row.
JOB_FILTER_JSON = (
    "struct<TaxonGroupIds:array<int>,CategoryIds:array<int>,OrganizationIds:array<int>,"
    "MunicipalityIds:array<string>,CountyIds:array<string>,RestrictedAreaIds:array<string>,"
    "OceanAreaIds:array<string>,BehaviorIds:array<int>,BasisOfRecordIds:array<int>,"
    "RegistrationStatusId:int,CoordinatePrecision:struct<From:int,To:int>,"
    "Period:struct<From:int,To:int,Months:array<int>>,ProjectName:string,ProjectOrganizationId:int,"
    "CollectionCode:string,CatalogNumber:string,WithImages:boolean,PreferredPopularName:string,"
    "ScientificName:string,Author:string,PageNumber:int,ResultsPerPage:int>"
)

# The two JSON shapes of a species response.
SPECIES_SEARCH_JSON = (
    "struct<taxonId:int,"
    "acceptedScientificName:struct<name:string,nameFormatted:string,author:string,rank:string>,"
    "preferredVernacularNames:array<struct<name:string,nameLanguageIso:string>>,"
    "vernacularNameSynonyms:array<struct<name:string,nameLanguageIso:string>>,"
    "scientificNameSynonyms:array<struct<name:string,nameFormatted:string,author:string,rank:string>>>"
)
SPECIES_BY_ID_JSON = (
    "struct<taxonId:int,scientificNames:array<struct<taxonomicStatus:string,"
    "scientificNamePresentation:string,scientificNamePresentationHtml:string,"
    "scientificNameAuthorship:string,taxonRank:string>>,"
    "vernacularNames:array<struct<vernacularName:string,vernacularNameStatus:string,languageIsoCode:string>>>"
)
