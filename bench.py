"""Headline queries on the given tables, timed: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Each query runs to its full result; the raw input of the cleaning queries is written beforehand.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "summarize_region", "calculate_filter", "fk_discovery", "auto_measures", "auto_breakdowns", "unify_backwards",
    "schema_summary", "audit_columns", "clean_deduplicate", "clean_winsorize", "clean_all_steps", "numeric_profile",
    "histogram", "frequencies", "pearson", "spearman", "groupby_insights", "grouped_metric_median", "page", "search_text",
    "trend_last15", "forecast14", "run_log_latest", "source_delimited", "anomalies", "kmeans_silhouettes", "key_drivers",
]


def main():
    from catalog.queries import QUERIES, dirty
    from plumbline.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    dirty(spark, sf_dir)
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()

    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    rows = {"lineitem_rows": spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()}
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), **rows,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
