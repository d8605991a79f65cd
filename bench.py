"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from haulscope.catalog.queries import QUERIES
from haulscope.session import prepare

HEADLINE = (
    "current_position", "nearest_stop", "dedup_events", "geofence_events", "eta_updates", "temperature_excursions",
    "unplanned_stops", "route_deviations", "signal_loss", "late_arrivals", "incident_table", "fleet_summary",
    "asof_vehicle", "canonical_events", "dead_letters", "manifest_outcomes", "archive_layout", "replay_report",
    "reconcile_ids", "latency_percentiles", "stream_geofence_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("haulscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    positions = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    QUERIES["fleet_bounds"](spark, sf_dir).collect()  # start the JVM's and Python's machinery
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "positions": positions,
                "batch_positions_per_sec_geofence": round(positions / seconds["geofence_events"]),
                "batch_positions_per_sec_geofence_eta": round(positions / seconds["eta_updates"]),
                "stream_positions_per_sec_geofence_eta": round(positions / seconds["stream_geofence_events"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
