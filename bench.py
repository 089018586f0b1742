"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  The stored log,
archive, plan and snapshot the queries read are built first and timed as ``prepare``.
Each query is run once to warm up and then timed ``BENCH_RUNS`` times; the best counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from logharbor import fixtures
from logharbor.catalog import all_queries

HEADLINE = [
    "poll_batches",
    "segment_roll",
    "archive_write",
    "plan_records",
    "plan_resume_records",
    "restore_topic",
    "restore_resume",
    "restore_skipped_rows",
    "group_snapshot",
    "translate_offsets",
    "group_status",
    "offset_gaps",
    "restore_duplicates",
    "restore_content_diff",
    "restore_order_violations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logharbor-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    archived = fixtures.archive(spark, sf_dir).count()
    restored = fixtures.restored(spark, sf_dir).count()
    fixtures.snapshot(spark, sf_dir).count()
    prepare = time.perf_counter() - start
    timings: dict[str, float] = {}
    queries = all_queries()
    for name in HEADLINE:
        best = None
        for run in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run and (best is None or took < best):
                best = took
        timings[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of best run times of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "prepare": round(prepare, 3),
                "archived_rows": archived,
                "restored_rows_per_sec": round(restored / timings["restore_topic"]),
            }
        )
    )


if __name__ == "__main__":
    main()
