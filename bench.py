"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from donorflow.catalog import load
from donorflow.session import build_session

HEADLINE = [
    "whole_series_features", "exclusion_audit", "days_to_previous_fb", "consecutive_deferrals", "recent_donations",
    "last_try_of_day", "calendar_range_count", "asof_previous_full_blood", "data_counts_by_age", "variable_summary",
    "suppressed_histogram", "threshold_sweep", "auroc_ci", "aupr", "optimal_f1_cut", "cost_by_threshold",
    "split_three_way", "stratified_sample", "lmm_design", "donor_effect_posterior", "posterior_effects", "shap_long",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    # one untimed round on the smallest tables, so that JVM start-up is not measured
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in HEADLINE[:2]:
        queries[name](spark, small if os.path.isdir(small) else folder).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
