"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: tables to read (default sf0.1). BENCH_CPUS: local cores. BENCH_REPEATS: timed runs per
query after one warm-up (default 1); the median is reported. Results go to a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from flowlens.catalog.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "flow_key",
    "flows_event_gap",
    "flows_replay_exact",
    "source_behaviour_past",
    "source_behaviour_replay",
    "flow_features",
    "host_sequences",
    "interval_labels",
    "chrono_split",
    "theta_sweep",
    "baseline_comparison",
    "class_report",
    "latency_summary",
    "alerts",
    "incidents",
    "dashboard_minute",
    "flow_features_replay",
    "stream_flows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    packets = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    line = {
        "metric": "total seconds of the headline queries, warm",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "packets_per_second_features": round(packets / times["flow_features"]),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
