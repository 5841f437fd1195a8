"""Wall time of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and threads.

Every query starts cold: caches of earlier queries are dropped before its clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["align", "price_distribution", "price_rolling", "price_autocorr", "price_calendar", "lead_scan_best", "spearman", "mutual_information", "rolling_stability", "granger",
            "stationarity", "normalize_series", "series_profile", "event_records", "link_events", "merge_fields", "state_history", "event_features", "restored_slots", "control_windows", "event_study", "visible_at_folds",
            "snapshots", "similar_day_prior", "forecast_metrics", "bm25", "retrieve"]


def main() -> None:
    from pyspark.sql import SparkSession
    from slotwise import plans
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("slotwise-bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    q, _ = plans.load()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for n in names:
        spark.catalog.clearCache()
        t = time.time()
        q[n](spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
