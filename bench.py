"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the number of local cores. Each query
runs twice and the faster run counts, every row being computed. Input files that a query reads (sentences,
CSV) are written beforehand and not timed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from wakeline.plans import catalog, rendering
from wakeline.plans.ingest import import_files
from wakeline.session import configure, scratch_path
from wakeline.sources import csv, sentences
from wakeline.sources.tables import Store

REGISTERED = [
    "validate_reasons", "dedup_keep_first", "vessel_merge", "vessel_upsert", "enrich_positions", "positions_range",
    "positions_at", "positions_series", "downsample_10s", "pre_downsample_60s", "track_build", "tracks_bbox",
    "tracks_geojson", "partition_bbox", "nmea_assemble", "ship_class",
]
RUNS = 2


def compute(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wakeline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)

    log = rendering.position_sentences(spark, sf_dir)
    daily = rendering.import_csv_files(spark, sf_dir)
    registered = catalog.registered()
    jobs = {name: (lambda q=registered[name]: compute(q(spark, sf_dir))) for name in REGISTERED}
    jobs["nmea_decode_positions"] = lambda: compute(
        sentences.decode_positions(sentences.read_sentences(spark, log, catalog.FALLBACK))
    )
    jobs["csv_positions"] = lambda: compute(csv.positions_of(csv.read_csv(spark, daily)))
    jobs["import_csv"] = lambda: import_files(spark, daily, Store(scratch_path(spark, "bench")))

    seconds = {}
    for name, job in jobs.items():
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            job()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
