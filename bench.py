"""Benchmark: prints one JSON line.

BENCH_SF_DIR   folder of the supplied tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEATS  timed runs per request, of which the median counts (default 2)
BENCH_DIR      folder for the stored tables, removed at the end (default: a temporary one)

``named.*`` are queries over the raw tables, mapping included. ``store`` maps and
writes the occurrence tables, ``index_build`` builds and writes the entity index
from them, and ``work.*`` are the requests of the workload over what was stored.
Every result is computed in full (no-op sink) after one untimed run.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from sightlines.operators.index import index_enriched, write_entity_index  # noqa: E402
from sightlines.plans.queries import queries  # noqa: E402
from sightlines.plans.workload import WORKLOAD  # noqa: E402
from sightlines.sources import OccurrenceTables, supplied_tables  # noqa: E402

NAMED = (
    "locations", "index_enriched", "f_combined_search", "observations_page", "area_counts_dynamic",
    "area_counts_subquery", "taxon_search", "export_rows", "sample_observations", "polygons", "bbox_overlap",
    "viewport_markers", "species_normalised", "history", "slow_log",
)
STORED = (
    "observation", "location", "location_area", "area", "area_type", "taxon", "taxon_name", "taxon_popular_name",
    "taxon_group", "organization", "organization_relation", "observation_tag", "observation_behavior", "media_file",
    "category_type", "category", "basis_of_record",
)


def _seconds(build) -> float:
    """One full run, planning included."""
    start = time.perf_counter()
    frame: DataFrame = build()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def _median(build, repeats: int) -> float:
    _seconds(build)
    return round(statistics.median(_seconds(build) for _ in range(repeats)), 4)


def _once(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sightlines-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    named = queries()
    for name in NAMED:
        times[f"named.{name}"] = _median(lambda: named[name](spark, sf_dir), repeats)

    root = tempfile.mkdtemp(prefix="sightlines-bench-", dir=os.environ.get("BENCH_DIR"))
    mapped = supplied_tables(spark, sf_dir)
    times["store"] = _once(lambda: [getattr(mapped, n).write.parquet(os.path.join(root, n)) for n in STORED])
    stored = OccurrenceTables.from_parquet(spark, root)
    index_path = os.path.join(root, "entity_index")
    times["index_build"] = _once(lambda: write_entity_index(index_enriched(stored), index_path))
    served = stored.with_stored_index(index_path)
    for name, request in WORKLOAD.items():
        times[f"work.{name}"] = _median(lambda: request(served), repeats)

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    shutil.rmtree(root)
    spark.stop()


if __name__ == "__main__":
    main()
