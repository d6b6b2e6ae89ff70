"""Observation sets as bucketed bitmaps (O-26, O-27, O-55, O-60).

For every value of a facet (an entity, a category, a month, ...) and every bucket of 32 768 ids that holds such an
observation there is one bitmap of 4 KB. A filter ORs the bitmaps of its values and ANDs those of its parts, bucket by
bucket: no id is shuffled, sorted or made distinct, and a value that a third of all observations have is spread over all
buckets. What is left is counted, turned into ids, met with other bitmaps, or asked for a row's bit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightlines import codes
from sightlines.functions.scalars import parse_entity_ids
from sightlines.operators.filters import ObservationFilter, apply_filters
from sightlines.operators.index import FILTER_COLUMNS, index_areas, index_institutions, observation_attributes
from sightlines.sources.shared import partitions_for, shuffle_partitions, stored
from sightlines.sources.tables import OccurrenceTables

SCHEMA = "value bigint, bucket bigint, n bigint, bitmap binary, facet string"
# The order in which bitmaps are stored.
_ORDER = ("facet", "value", "bucket")
# Buckets that are counted together first when a page is looked for.
BUCKETS_TOGETHER = 1_024
# Facets beside "entity_<type>"; "all" has one value, which all observations have. A year counts double, and one more in its last second, which a period's end leaves out.
_ATTRIBUTES = {
    "all": "0",
    "taxon_group": "taxon_group_id",
    "category": "category_id",
    "basis": "basis_of_record_id",
    "status": "registration_status_id",
    "media": "CAST(has_media_files AS INT)",
    "month": "month(date_time_collected)",
    "year": (
        "2 * year(date_time_collected) + CAST(date_time_collected > make_timestamp_ntz(year(date_time_collected), 12, 31,"
        " 23, 59, 59) AS INT)"
    ),
}
# Fields of a request that bitmaps answer.
_ANSWERED = (
    "taxon_group_ids", "category_ids", "basis_of_record_ids", "organization_ids", "municipality_ids", "county_ids",
    "restricted_area_ids", "ocean_area_ids", "behavior_ids", "registration_status_id", "period_from", "period_to", "months",
    "with_images",
)


def _facet_parts(tables: OccurrenceTables, partitions: int | None = None) -> list[DataFrame]:
    """(facet, value, observation_id) from each table that holds facets, null values left out; no facet is in two parts.

    ``partitions`` is a number that observations are dealt into, see ``observation_attributes``.
    """
    attributes = ", ".join(f"struct('{k}' AS facet, CAST({e} AS BIGINT) AS value)" for k, e in _ATTRIBUTES.items())
    own = observation_attributes(tables, partitions).selectExpr(f"inline(array({attributes}))", "observation_id")
    derived = [tables.entity_index] if tables.has_stored_index else [index_areas(tables), index_institutions(tables)]
    entities = [
        index.selectExpr("concat('entity_', entity_type_id) AS facet", "CAST(entity_id AS BIGINT) AS value", "observation_id")
        for index in derived
    ]
    behaviors = tables.observation_behavior.selectExpr("'behavior' AS facet", "CAST(behavior_id AS BIGINT) AS value", "observation_id")
    tags = tables.observation_tag.selectExpr("'tag' AS facet", "CAST(tag_id AS BIGINT) AS value", "observation_id")
    return [part.where("value IS NOT NULL AND observation_id IS NOT NULL") for part in (own, *entities, behaviors, tags)]


def facet_values(tables: OccurrenceTables) -> DataFrame:
    """(facet, value, observation_id), null values left out, as no filter matches them."""
    return reduce(DataFrame.unionByName, _facet_parts(tables))


def facet_bitmaps(tables: OccurrenceTables, files: int | None = None) -> DataFrame:
    """(value, bucket, n, bitmap, facet) of all facets; an observation that stands twice below a value is one bit.

    Ids are dealt by ranges of (facet, value, bucket) before their bitmaps are built, so that 4 KB move for no partial
    bitmap, and every partition is in the order in which bitmaps are stored. ``files`` is the number of ranges, by default that
    of shuffle partitions; given as a number, they are not put together by their compressed size.
    """
    return _built(facet_values(tables), files or shuffle_partitions(tables.spark))


def _built(facets: DataFrame, files: int) -> DataFrame:
    bucket, position = F.bitmap_bucket_number("observation_id"), F.bitmap_bit_position("observation_id")
    keyed = facets.select("facet", "value", bucket.alias("bucket"), position.cast("int").alias("position"))
    dealt = keyed.repartitionByRange(files, *_ORDER)
    return _counted(dealt.groupBy(*_ORDER).agg(F.bitmap_construct_agg(F.col("position").cast("bigint")).alias("bitmap")))


def write_facet_bitmaps(tables: OccurrenceTables, path: str, files: int | None = None) -> None:
    """Store the bitmaps of all facets, those of each table by jobs of its own.

    In one job, all tables' rows would be joined and made distinct in one stage and share the few tasks that adaptive execution
    leaves it. The observations' columns are stored first, and so are each table's rows: sampling ranges derives nothing again,
    and the number of ranges follows the number of rows, so that more rows are more tasks and not larger ones.
    """
    columns = tables.observation.select("observation_id", "location_id", *FILTER_COLUMNS[:5])
    tables = tables.with_table("observation", stored(columns, "facet_observations"))
    for i, part in enumerate(_facet_parts(tables, partitions_for(tables.observation))):
        rows = stored(part, "facet_rows")
        write_bitmaps(_built(rows, files or partitions_for(rows)), path, mode="append" if i else "error", dealt=True)


def _counted(bitmaps: DataFrame) -> DataFrame:
    """Bitmaps with the directory column ``n``, their number of observations."""
    return bitmaps.select("value", "bucket", F.bitmap_count("bitmap").alias("n"), "bitmap", "facet")


def merged_bitmaps(*parts: DataFrame) -> DataFrame:
    """Bitmaps of several sets of observations as those of their union: how new observations are added."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return _counted(every.groupBy("value", "bucket", "facet").agg(F.bitmap_or_agg("bitmap").alias("bitmap")))


def write_bitmaps(bitmaps: DataFrame, path: str, mode: str = "error", files: int | None = None, dealt: bool = False) -> None:
    """Store bitmaps partitioned by facet and sorted by value, so that a filter reads the rows of its values.

    ``dealt`` says that they come straight from ``facet_bitmaps``: they are in ranges then, and neither moved nor sorted.
    """
    if not dealt:
        bitmaps = bitmaps.repartitionByRange(*([files] if files else []), *_ORDER)
    bitmaps.sortWithinPartitions(*_ORDER).write.mode(mode).partitionBy("facet").parquet(path)


def has_bit(bitmap: str, position: str) -> str:
    """Whether a bitmap holds a position, as an SQL condition."""
    byte = f"conv(hex(substring({bitmap}, CAST({position} div 8 AS INT) + 1, 1)), 16, 10)"
    return f"getbit(CAST({byte} AS INT), CAST({position} % 8 AS INT)) = 1"


def _within(facet: str, values: list[int] | tuple[int, ...]) -> str:
    listed = ", ".join(str(int(v)) for v in values)
    return f"(facet = '{facet}' AND value IN ({listed}))" if values else "FALSE"


def _single(part: str) -> bool:
    """Whether a condition names one value of one facet."""
    return re.fullmatch(r"\(facet = '\w+' AND value IN \(-?\d+\)\)", part) is not None


def _geography(f: ObservationFilter, polar: bool) -> list[str]:
    counties = parse_entity_ids(f.county_ids)
    wanted = [
        (codes.MUNICIPALITY, parse_entity_ids(f.municipality_ids)),
        (codes.COUNTY, counties),
        (codes.RESTRICTED_AREA, parse_entity_ids(f.restricted_area_ids, codes.RESTRICTED_FID_PREFIX)),
        (codes.OCEAN_AREA, parse_entity_ids(f.ocean_area_ids)),
    ]
    if polar:
        wanted.append((codes.POLAR_ISLANDS, counties))
    return [_within(f"entity_{kind}", ids) for kind, ids in wanted if ids] or ["FALSE"]


def parts_of(f: ObservationFilter, mode: str = "search") -> list[str]:
    """Conditions on (facet, value), one for each part of a request; no row meets two of them.

    ``search`` and ``export`` judge as ``apply_filters``, ``counts`` takes status and media as the entity index has
    them (T-04). Fields that bitmaps don't answer are passed over; see ``rest_of``.
    """
    parts = [
        _within(facet, values)
        for facet, values in (
            ("taxon_group", f.taxon_group_ids), ("category", f.category_ids), ("basis", f.basis_of_record_ids),
            ("behavior", f.behavior_ids), ("month", f.months),
        )
        if values
    ]
    if f.period_from is not None or f.period_to is not None:
        bounds = [f"value >= {2 * f.period_from}"] if f.period_from is not None else []
        bounds += [f"value <= {2 * f.period_to}"] if f.period_to is not None else []
        parts.append(f"(facet = 'year' AND {' AND '.join(bounds)})")
    institutions = _within(f"entity_{codes.INSTITUTION}", f.organization_ids)
    if mode == "export" and f.organization_ids:
        parts.append(" OR ".join([*_geography(f, polar=False), institutions]))
        return parts
    if f.has_geography:
        parts.append(" OR ".join(_geography(f, polar=mode != "export")))
    if mode == "export":
        return parts
    if f.organization_ids:
        parts.append(institutions)
    status = f.registration_status_id
    if mode == "counts" and status is not None or status == codes.STATUS_FOUND:
        parts.append(_within("status", [status]))
    elif status in (codes.STATUS_ABSENT, codes.STATUS_NOT_RECOVERED):
        parts.append(_within("tag", [codes.TAG_ABSENT if status == codes.STATUS_ABSENT else codes.TAG_NOT_RECOVERED]))
    if f.with_images is not None:
        parts.append(_within("media", [int(f.with_images)]))
    return parts


def rest_of(f: ObservationFilter) -> ObservationFilter:
    """The request without what bitmaps answer."""
    return f.but(**{name: () if isinstance(getattr(f, name), tuple) else None for name in _ANSWERED})


@dataclass(frozen=True)
class Bitmaps:
    """Stored facet bitmaps of all observations."""

    spark: SparkSession
    path: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def answers(self, f: ObservationFilter) -> bool:
        """Whether bitmaps alone decide a request."""
        return rest_of(f).matches_all and f.envelope is None

    def chosen(
        self, f: ObservationFilter, mode: str = "search", between: tuple[int, int] | None = None
    ) -> DataFrame:
        """(bucket, bitmap) of the observations that meet all parts of a request, of some buckets or of all."""
        parts = parts_of(f, mode) or [_within("all", [0])]
        number = "CASE " + " ".join(f"WHEN {part} THEN {i}" for i, part in enumerate(parts)) + " END"
        kept = self.rows.where(" OR ".join(f"({part})" for part in parts))
        if between is not None:
            kept = kept.where(F.col("bucket").between(*between))
        kept = kept.selectExpr("bucket", f"{number} AS part", "bitmap")
        any_of = kept.groupBy("bucket", "part").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        if len(parts) == 1:
            return any_of.select("bucket", "bitmap")
        all_of = any_of.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bitmap").alias("bitmap"))
        return all_of.where(f"n = {len(parts)} AND bitmap_count(bitmap) > 0").select("bucket", "bitmap")

    def count(self, f: ObservationFilter, mode: str = "search") -> DataFrame:
        """One row: how many observations a request matches (O-60)."""
        return self.chosen(f, mode).agg(F.expr("coalesce(sum(bitmap_count(bitmap)), 0L) AS n"))

    def ids(self, f: ObservationFilter, mode: str = "search", between: tuple[int, int] | None = None) -> DataFrame:
        """Ids of the matching observations; a bitmap is taken apart eight bytes at a time."""
        words = self.chosen(f, mode, between).selectExpr("bucket", "bitmap", "explode(sequence(0, 511)) AS w")
        words = words.selectExpr("bucket", "w", f"{_reversed('substring(bitmap, 8 * w + 1, 8)')} AS word")
        bits = words.where("word <> 0").selectExpr(
            "bucket", "explode(filter(transform(sequence(0, 63), i -> IF(getbit(word, i) = 1, 64 * w + i, -1)), p -> p >= 0)) AS p"
        )
        return bits.selectExpr("IF(bucket > 0, (bucket - 1) * 32768 + p + 1, bucket * 32768 - p) AS observation_id")

    def bucket_counts(self, f: ObservationFilter, mode: str = "search") -> DataFrame:
        """(bucket, n): matching observations by bucket, empty ones left out.

        A request for one value has them in the directory, so that no bitmap is read; others need their bitmaps.
        """
        parts = parts_of(f, mode) or [_within("all", [0])]
        if len(parts) == 1 and _single(parts[0]):
            return self.rows.where(parts[0]).select("bucket", "n")
        return self.chosen(f, mode).select("bucket", F.bitmap_count("bitmap").alias("n")).where("n > 0")

    def window(self, f: ObservationFilter, skip: int, take: int, mode: str = "search") -> DataFrame:
        """Ids of the matching rows ``skip`` .. ``skip + take`` in id order, for pages of any depth. Runs one job.

        Prefix sums of the counts, first over many buckets together and then inside those that hold an end, find the
        buckets of the window; their bitmaps are read and nothing else. A bucket at each end and ``take`` ids are sorted.
        """
        counts = self.bucket_counts(f, mode).withColumn("together", F.expr(f"floor(bucket / {BUCKETS_TOGETHER})"))
        sums = counts.groupBy("together").agg(F.sum("n").alias("sum"))
        before = F.coalesce(F.sum("sum").over(Window.orderBy("together").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select("together", before.alias("start"), "sum").where(f"start < {skip + take} AND start + sum > {skip}")
        inside = Window.partitionBy("together").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.join(sums, "together").withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        placed = placed.where(f"start < {skip + take} AND start + n > {skip}")
        low, high, start = placed.agg(F.min("bucket"), F.max("bucket"), F.min("start")).first()
        if low is None or take <= 0:
            return self.ids(f, mode, (0, -1))
        found = self.ids(f, mode, (low, high)).orderBy("observation_id")
        return found.offset(skip - start).limit(take)

    def entity_counts(self, f: ObservationFilter, keys: DataFrame) -> DataFrame:
        """O-55: matching observations of each wanted (entity_type_id, entity_id), zero ones left out."""
        chosen = self.chosen(f, "counts").withColumnRenamed("bitmap", "chosen")
        entities = self.rows.where("startswith(facet, 'entity_')").selectExpr(
            "CAST(substring(facet, 8) AS INT) AS entity_type_id", "CAST(value AS INT) AS entity_id", "bucket", "bitmap"
        )
        entities = entities.join(keys, ["entity_type_id", "entity_id"], "left_semi")
        both = entities.join(chosen, "bucket").selectExpr(
            "entity_type_id", "entity_id", "bucket", "explode(array(bitmap, chosen)) AS bitmap"
        )
        common = both.groupBy("entity_type_id", "entity_id", "bucket").agg(
            F.bitmap_count(F.bitmap_and_agg("bitmap")).alias("n")
        )
        counts = common.groupBy("entity_type_id", "entity_id").agg(F.sum("n").alias("observation_count"))
        return counts.where("observation_count > 0")


def _reversed(eight: str) -> str:
    """Eight bytes, the lowest first, as a number."""
    parts = "||".join(f"substring(hex({eight}), {2 * i + 1}, 2)" for i in reversed(range(8)))
    return f"CAST(conv({parts}, 16, -10) AS BIGINT)"


def rows_in(df: DataFrame, chosen: DataFrame, key: Column | str = "observation_id") -> DataFrame:
    """Rows whose id has its bit in ``chosen``; they meet by bucket, and a bucket holds 32 768 ids at most."""
    keyed = df.withColumns({"_bucket": F.bitmap_bucket_number(key), "_position": F.bitmap_bit_position(key)})
    met = keyed.join(chosen.withColumnsRenamed({"bucket": "_bucket", "bitmap": "_bitmap"}), "_bucket")
    return met.where(has_bit("_bitmap", "_position")).select(*[f"`{c}`" for c in df.columns])


def apply_bitmaps(df: DataFrame, tables: OccurrenceTables, f: ObservationFilter, mode: str = "search") -> DataFrame:
    """``apply_filters`` with bitmaps for all they answer and the other filters on the rows that are left."""
    f.validate()
    if parts_of(f, mode):
        df = rows_in(df, tables.bitmaps.chosen(f, mode))
    return apply_filters(df, tables, rest_of(f), mode)
