"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is executed in full through the ``noop`` sink (no driver collect), after
one warm-up query that pays JVM start and code loading.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "queue_roi", "review_queue", "failure_mode_rank", "model_rank", "binary_metrics", "calibration",
    "strat_split", "drift_report", "bootstrap_drift", "rolling_features", "rul_eval", "oee", "wear_reset",
    "running_totals", "cost_by_mode", "importance_share", "mean_abs_contribution", "derived_features",
    "orders_review_queue", "lineitem_ranking_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from wearline.plans.catalog import QUERIES
    from wearline.session import get_spark

    spark = get_spark("wearline-bench", cpus=cpus)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # warm-up on the smallest data set (JIT, code generation, class loading); not timed
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for name in ("review_queue", "drift_report", "rolling_features"):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    fits = _fit_times(spark, sf_dir) if os.environ.get("BENCH_FITS", "1") == "1" else {}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "n_queries": len(timings),
        "fits": fits,
    }))


def _fit_times(spark, sf_dir: str) -> dict:
    """Wall clock around ``fit`` (preprocessing included, as the reference measures) for the
    benchmark models on the stratified training split of the readings."""
    from wearline.ml import workflows as W
    from wearline.operators.features import add_derived_features
    from wearline.sources.adapters import CATEGORICAL_FEATURES, NUMERIC_FEATURES, readings

    train, test = W.split_frames(add_derived_features(readings(spark, sf_dir)))
    out = {"train_rows": train.count()}
    for name, kind, w in (("logistic_regression", "logistic", "weight"), ("random_forest_300", "forest", "weight"),
                          ("gradient_boosting", "histogram", None)):
        _, _, secs = W.fit_score(kind, train, test, NUMERIC_FEATURES, CATEGORICAL_FEATURES, weight=w, **({"max_depth": 5} if kind == "histogram" else {}))
        out[name] = round(secs, 3)
    return out


if __name__ == "__main__":
    main()
