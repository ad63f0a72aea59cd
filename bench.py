"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tabscout.session import get_spark  # noqa: E402
from workload import registry  # noqa: E402

HEADLINE = [
    "a02_infer_types", "a05_build_catalog", "c04_duplicate_rows", "c09_target_entropy",
    "c12_mean_abs_correlation", "c13_profile", "c14_profile_many", "c17_describe",
    "d07_category_codes", "d11_median_impute", "d11_exact_quantiles", "d12_standard_scale",
    "d17_prepare_features", "e01_stratified_split", "e02_stratified_folds",
    "f01_logistic_regression", "f02_decision_tree", "f05_naive_bayes", "f11_neighbour_votes",
    "g06_class_report", "g11_rmse", "h01_rules_classification", "h07_recommend",
    "i01_score", "j09_latest", "j13_missing_cells", "j16_resume_plan", "j17_upsert",
    "j20_summary", "j29_leaderboard", "j30_best_per_dataset", "j36_finalise",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's threads and the Python workers.
    registry.ALL["c12_mean_abs_correlation"][0](spark, sf_dir).collect()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        started = time.perf_counter()
        # Every row is computed, none is sent to the driver.
        registry.ALL[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
