"""Time the headline queries: one warm-up, then the median of five runs each.

The runs go round by round through all queries, so that none is timed in a colder
JVM than the others. Every run builds its DataFrame anew, so that no shuffle is reused. The measure
table is built in the warm-up and kept, so that the views are timed without it. Queries in
``COLLECTED`` are also timed with their rows sent to the driver. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from areashare.plans.queries import build_queries  # noqa: E402

HEADLINE = (
    "share_measure",
    "share_measure_sql",
    "national_rollup",
    "area_layer",
    "percentile_bands",
    "snapshot_diff",
    "sanitise_text",
    "ieee_divide",
    "report_trend",
)
COLLECTED = ("ordered_measure",)
RUNS = 5


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("areashare-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="areashare-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(query, spark: SparkSession, sf_dir: str, collected: bool) -> float:
    start = time.perf_counter()
    if collected:
        query(spark, sf_dir).collect()
    else:
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE + COLLECTED
    spark = session(cpus)
    found = build_queries()
    runs = {name: [] for name in names}
    for _ in range(1 + RUNS):
        for name in names:
            runs[name].append(timed(found[name], spark, sf_dir, name in COLLECTED))
    seconds = {name: round(statistics.median(taken[1:]), 4) for name, taken in runs.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
