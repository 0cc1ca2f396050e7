"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries",
"sf"}. ``BENCH_EVENT_LOG=<dir>`` also writes Spark's event log (stage and task
times) to a fresh folder under <dir>. Each query is planned from the parquet files and fully executed
(``noop`` sink, so no result is shipped to the driver). An untimed warm-up
absorbs process start-up: one small query (JVM, codegen) and one tiny
Arrow-batched group (Python worker start).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pareto_summary", "pareto_curve", "descriptive_stats", "gini", "lorenz_curve",
    "rate_histogram", "chi_square", "hotspots", "record_enriched", "risk_counts",
    "predominant_month", "kpi_top_state", "months_long", "mart_pivot", "features_scaled",
    "cluster_names", "outlier_anomaly", "silhouette_exact", "dbscan_points", "kmeans_metrics",
    "dbscan_pipeline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from terrastat.session import get_session
    from terrastat.plans.registry import QUERIES
    from terrastat.operators import dbscan as DB
    from terrastat.sources import fixtures as fx
    from pyspark.sql import functions as F

    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):
        # stage and task times for later study: Spark's event log in a fresh
        # scratch folder (no UI, no server)
        import tempfile
        log_dir = tempfile.mkdtemp(prefix="bench-events-", dir=os.environ["BENCH_EVENT_LOG"])
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir}
        print(f"# event log: {log_dir}", file=sys.stderr)
    spark = get_session(f"local[{cpus}]", extra=extra,
                        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))

    def dbscan_points(sp, sf):
        # timing setting of the survey: eps 0.1, min_samples 20 on the customer points
        return DB.dbscan_labels(fx.points(sp, sf), "k", ["x", "y"], 0.1, 20)

    runners = dict(QUERIES)
    runners["dbscan_points"] = dbscan_points
    # warm-up (untimed): JVM/codegen and the Python worker pool
    QUERIES["kpi_total"](spark, sf_dir).collect()
    spark.range(8).withColumn("g", F.col("id") % 2).groupBy("g").applyInPandas(
        lambda pdf: pdf, "id long, g long").collect()
    times, failed = {}, {}
    for name in (only or HEADLINE):
        t0 = time.time()
        spark.sparkContext.setJobGroup(name, name)  # attributes jobs in the event log
        try:
            df = runners[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # keep the JSON line; report the failure
            failed[name] = str(e)[:200]
            print(f"# {name}: FAILED {failed[name]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1).rstrip(".")) if m else sf_dir}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
