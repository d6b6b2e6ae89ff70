"""Observation export (O-03, O-16, O-19, O-20, O-47, O-60)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlines import codes, schema
from sightlines.functions.scalars import export_slug, number_text, quoted
from sightlines.operators.filters import ObservationFilter, apply_filters
from sightlines.sources.tables import OccurrenceTables


@dataclass(frozen=True)
class ExportColumn:
    """A column a user may choose: request name, header, source column, in the default set."""

    name: str
    header: str
    source: str
    default: bool = False

    @property
    def is_detail(self) -> bool:
        return self.name.startswith("Detail.")


# Request names, headers and default choice of the export columns.
COLUMNS = (
    ExportColumn("Id", "Id", "observation_id", True),
    ExportColumn("ProxyId", "ProxyId", "proxy_id"),
    ExportColumn("OccurrenceId", "OccurrenceId", "occurrence_id", True),
    ExportColumn("NodeId", "NodeId", "node_id"),
    ExportColumn("InstitutionCode", "Institusjonskode", "institution_code", True),
    ExportColumn("CollectionCode", "Samlingskode", "collection_code", True),
    ExportColumn("CatalogNumber", "Katalognummer", "catalog_number", True),
    ExportColumn("BasisOfRecordId", "Funntype-ID", "basis_of_record_id"),
    ExportColumn("DateTimeCollected", "Innsamlingsdato", "date_time_collected", True),
    ExportColumn("DatetimeIdentified", "Bestemmelsesdato", "datetime_identified"),
    ExportColumn("DateLastModified", "Sist endret", "date_last_modified"),
    ExportColumn("DateTimeRecordImported", "Importert", "date_time_record_imported"),
    ExportColumn("TaxonId", "Takson-ID", "taxon_id", True),
    ExportColumn("MatchedScientificNameId", "Matchet vitenskapelig navn-ID", "matched_scientific_name_id"),
    ExportColumn("TaxonGroupId", "Taksongruppe-ID", "taxon_group_id"),
    ExportColumn("CategoryId", "Kategori-ID", "category_id"),
    ExportColumn("Latitude", "Breddegrad", "latitude", True),
    ExportColumn("Longitude", "Lengdegrad", "longitude", True),
    ExportColumn("East", "Øst (UTM33)", "east"),
    ExportColumn("North", "Nord (UTM33)", "north"),
    ExportColumn("CoordinatePrecisionInMeters", "Koordinatpresisjon (meter)", "coordinate_precision_m", True),
    ExportColumn("YearCollected", "Innsamlingsår", "year_collected"),
    ExportColumn("MonthCollected", "Innsamlingsmåned", "month_collected"),
    ExportColumn("HasErrors", "Har feil", "has_errors"),
    ExportColumn("HasAnnotations", "Har annoteringer", "has_annotations"),
    ExportColumn("ObservationQualityTypeId", "Kvalitetstype-ID", "observation_quality_type_id"),
    ExportColumn("Detail.DatasetName", "Datasett", "dataset_name", True),
    ExportColumn("Detail.DatasetId", "Datasett-ID", "dataset_id"),
    ExportColumn("Detail.Collector", "Innsamler", "collector", True),
    ExportColumn("Detail.IndividualCount", "Antall individer", "individual_count"),
    ExportColumn("Detail.Notes", "Merknader", "notes"),
    ExportColumn("Detail.IdentifiedBy", "Bestemt av", "identified_by"),
    ExportColumn("Detail.Locality", "Lokalitet", "locality", True),
    ExportColumn("Detail.Habitat", "Habitat", "habitat"),
    ExportColumn("Detail.Sex", "Kjønn", "sex"),
    ExportColumn("Detail.CollectingMethod", "Innsamlingsmetode", "collecting_method"),
    ExportColumn("Detail.RecordNumber", "Postnummer", "record_number"),
    ExportColumn("Detail.FieldNumber", "Feltnummer", "field_number"),
    ExportColumn("Detail.MeasurementMethod", "Målemetode", "measurement_method"),
    ExportColumn("Detail.GeoreferenceRemarks", "Georeferanse-merknader", "georeference_remarks"),
    ExportColumn("Detail.Preparations", "Preparering", "preparations"),
    ExportColumn("Detail.OtherCatalogNumbers", "Andre katalognumre", "other_catalog_numbers"),
    ExportColumn("Detail.TypeStatus", "Typestatus", "type_status"),
    ExportColumn("Detail.EventTime", "Hendelsestid", "event_time"),
    ExportColumn("Detail.MaximumElevationInMeters", "Maks høyde (meter)", "maximum_elevation_m"),
    ExportColumn("Detail.MinimumElevationInMeters", "Min høyde (meter)", "minimum_elevation_m"),
    ExportColumn("Detail.VerbatimDepth", "Dybde (tekst)", "verbatim_depth"),
    ExportColumn("Detail.DynamicProperties", "Dynamiske egenskaper", "dynamic_properties"),
    ExportColumn("Detail.AssociatedReferences", "Tilknyttede referanser", "associated_references"),
)

_BY_NAME = {c.name.lower(): c for c in COLUMNS}


def default_columns() -> list[ExportColumn]:
    return [c for c in COLUMNS if c.default]


def resolve_columns(names: list[str] | tuple[str, ...]) -> list[ExportColumn]:
    """O-19: known columns in request order, names ignoring case (T-19); none known gives the defaults."""
    known = [_BY_NAME[n.lower()] for n in names if n.lower() in _BY_NAME]
    return known or default_columns()


def _with_computed(observations: DataFrame) -> DataFrame:
    """O-08: year and month of collection are derived, not stored."""
    collected = F.col("date_time_collected")
    return observations.withColumn("year_collected", F.year(collected)).withColumn(
        "month_collected", F.month(collected)
    )


def export_rows(
    tables: OccurrenceTables, f: ObservationFilter, columns: list[str] | tuple[str, ...] = (), headers: bool = True
) -> DataFrame:
    """Typed export rows. The detail table is joined only when one of its columns is chosen (O-47).

    ``headers=False`` names the columns after their source. A source column the
    table does not have reads as null.
    """
    chosen = resolve_columns(columns)
    rows = _with_computed(apply_filters(tables.observation, tables, f, mode="export"))
    facts = set(rows.columns)
    details: set[str] = set()
    if any(c.is_detail for c in chosen):
        details = set(tables.observation_detail.columns)
        wanted = [c.source for c in chosen if c.is_detail and c.source in details]
        detail = tables.observation_detail.select(
            F.col("observation_id"), *[F.col(s).alias(f"detail_{s}") for s in dict.fromkeys(wanted)]
        )
        rows = rows.join(detail, "observation_id", "left")

    def value(c: ExportColumn) -> Column:
        if c.is_detail:
            return F.col(f"detail_{c.source}") if c.source in details else F.lit(None).cast("string")
        return F.col(c.source) if c.source in facts else F.lit(None).cast("string")

    return rows.select(*[value(c).alias(c.header if headers else _plain_name(c)) for c in chosen])


def _plain_name(c: ExportColumn) -> str:
    return f"detail_{c.source}" if c.is_detail else c.source


def as_text(rows: DataFrame) -> DataFrame:
    """Every column in its CSV form: dates ``yyyy-MM-dd HH:mm:ss``, booleans 1/0, invariant numbers."""

    def text(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        if kind == "boolean":
            return column.cast("int").cast("string")
        if kind in ("double", "float"):
            return F.expr(number_text(f"CAST(`{name}` AS DOUBLE)"))
        return column.cast("string")

    return rows.select(*[text(n, t).alias(n) for n, t in rows.dtypes])


def csv_line(columns: list[str]) -> Column:
    """One ``;``-separated line; a field is quoted only when it needs to be, null is empty."""

    def field(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.rlike(text, F.lit('[;"\\n\\r]')), quoted).otherwise(text)

    return F.concat_ws(";", *[field(c) for c in columns])


def export_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, CSV line) per typed row."""
    text = as_text(rows)
    return text.select(F.col(f"`{key}`").cast("bigint").alias("observation_id"), csv_line(text.columns).alias("line"))


def export_summary(
    tables: OccurrenceTables,
    f: ObservationFilter,
    columns: list[str] | tuple[str, ...] = (),
    name: str | None = None,
    soft_limit: int = codes.EXPORT_SOFT_LIMIT,
    hard_limit: int = codes.EXPORT_HARD_LIMIT,
) -> DataFrame:
    """O-60, O-20: exact row count, estimated size, limits (T-20) and file name, as one row."""
    selected = len(columns) or len(default_columns())
    row_bytes = codes.EXPORT_BYTES_PER_FULL_ROW * (selected / len(COLUMNS)) + (selected + 1)
    matching = apply_filters(tables.observation, tables, f, mode="export")
    return matching.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        F.floor(F.col("total_rows") * F.lit(row_bytes)).cast("bigint").alias("estimated_bytes"),
        (F.col("total_rows") > soft_limit).alias("exceeds_soft_limit"),
        (F.col("total_rows") > hard_limit).alias("exceeds_hard_limit"),
        F.expr(export_slug("CAST(NULL AS STRING)" if name is None else quoted(name))).alias("export_name"),
    )


def limit_check(matching: DataFrame, limit: int = codes.EXPORT_HARD_LIMIT) -> DataFrame:
    """O-60 inside a plan: one row, is there more than ``limit``? Counts where the data lies."""
    return matching.agg((F.count("*") > limit).alias("exceeds_limit"))


def exceeds_limit(matching: DataFrame, limit: int = codes.EXPORT_HARD_LIMIT) -> bool:
    """O-60 as an action that stops reading once ``limit + 1`` rows were seen."""
    return not matching.select(F.lit(1)).offset(limit).isEmpty()


def parsed_jobs(jobs: DataFrame) -> DataFrame:
    """O-03: stored JSON filter and column list as typed columns; a missing list is empty."""
    return jobs.select(
        "job_id",
        "user_id",
        "name",
        F.from_json("filter_json", schema.JOB_FILTER_JSON).alias("filter"),
        F.coalesce(F.from_json("selected_columns", "array<string>"), F.array().cast("array<string>")).alias("columns"),
        F.expr(export_slug("name")).alias("slug"),
    )


def known_job_columns(jobs: DataFrame) -> DataFrame:
    """The valid columns of each job, in request order: (job_id, position, column, header).

    A job without a valid column gets the defaults.
    """
    names = F.array(*[F.lit(n) for n in _BY_NAME])
    requested = F.filter("columns", lambda c: F.array_contains(names, F.lower(c)))
    fallback = F.array(*[F.lit(c.name) for c in default_columns()])
    chosen = parsed_jobs(jobs).select(
        "job_id", F.posexplode(F.when(F.size(requested) > 0, requested).otherwise(fallback)).alias("position", "column")
    )
    headers = F.create_map(*[F.lit(x) for c in COLUMNS for x in (c.name.lower(), c.header)])
    return chosen.withColumn("header", F.element_at(headers, F.lower("column")))


def job_filter(parsed_filter) -> ObservationFilter:
    """The request of one parsed job row."""
    p = parsed_filter
    precision, period = p["CoordinatePrecision"], p["Period"]
    return ObservationFilter(
        taxon_group_ids=p["TaxonGroupIds"],
        category_ids=p["CategoryIds"],
        organization_ids=p["OrganizationIds"],
        municipality_ids=p["MunicipalityIds"],
        county_ids=p["CountyIds"],
        restricted_area_ids=p["RestrictedAreaIds"],
        ocean_area_ids=p["OceanAreaIds"],
        behavior_ids=p["BehaviorIds"],
        basis_of_record_ids=p["BasisOfRecordIds"],
        registration_status_id=p["RegistrationStatusId"],
        precision_from=precision["From"] if precision else None,
        precision_to=precision["To"] if precision else None,
        period_from=period["From"] if period else None,
        period_to=period["To"] if period else None,
        months=period["Months"] if period else (),
        project_name=p["ProjectName"],
        project_organization_id=p["ProjectOrganizationId"],
        collection_code=p["CollectionCode"],
        catalog_number=p["CatalogNumber"],
        with_images=p["WithImages"],
        preferred_popular_name=p["PreferredPopularName"],
        scientific_name=p["ScientificName"],
        author=p["Author"],
        page_number=p["PageNumber"],
        results_per_page=p["ResultsPerPage"],
    )


def run_job(tables: OccurrenceTables, job_id: int) -> tuple[DataFrame, str]:
    """Export rows and file slug of one stored job."""
    job = parsed_jobs(tables.export_job.where(F.col("job_id") == job_id)).first()
    if job is None:
        raise ValueError(f"no export job {job_id}")
    f = job_filter(job["filter"]) if job["filter"] is not None else ObservationFilter()
    return export_rows(tables, f, job["columns"]), f"{job_id}-{job['slug']}"
