"""Benchmark: headline loan-portfolio queries on local[$BENCH_CPUS].

Runs each query end to end (read parquet -> derive loans -> score -> report)
with a ``noop`` write, which executes the whole plan without shipping rows
to the driver. Report queries take the best of two runs (the first pays
JIT/codegen warm-up); the model fit runs once. Prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_ML (default 1: include the model fit and model scoring).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanframe.plans.catalog import PLANS, fitted_models  # noqa: E402
from loanframe.session import local_session  # noqa: E402

REPORTS = [
    "portfolio_metrics", "segments_geography", "segments_product", "risk_distribution", "cohort_analysis",
    "ew_bands", "ew_buckets", "cluster_profiles_rule", "pricing_report", "early_warning_top50",
    "early_warning_by_grade", "auc_rule", "policy_recommendations", "scored_loans", "normalize_loans",
    "csv_roundtrip",
]
MODEL_QUERIES = ["ml_ew_score", "cluster_profiles", "predict_loans", "anomaly_scores"]


def run(spark, name: str, sf: str) -> float:
    t = time.perf_counter()
    PLANS[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with_ml = os.environ.get("BENCH_ML", "1") != "0"
    # The settings that any user of a small local session gets with ``small_tables``.
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="loanframe-bench", small_tables=True)
    times: dict[str, float] = {}
    for name in REPORTS:
        times[name] = round(min(run(spark, name, sf), run(spark, name, sf)), 3)
    if with_ml:
        t = time.perf_counter()
        fitted_models(spark, sf)
        times["fit_models"] = round(time.perf_counter() - t, 3)
        for name in MODEL_QUERIES:
            times[name] = round(run(spark, name, sf), 3)
    m = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
