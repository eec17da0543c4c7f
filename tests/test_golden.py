"""Golden vectors: the reference's stored results fed through our operators (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from wearline.operators import economics, metrics, queue, reports


def _scored(spark, n, positives_at):
    """n assets ranked by a strictly decreasing score; failures at the given 1-based ranks."""
    rows = [(i, float(n - i) / n, 1 if i in positives_at else 0) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "product_id long, risk double, machine_failure int")


def test_queue_roi_golden(spark):
    # 2,000 holdout rows, 68 failures: 61 in the top 100, 64 in the top 200, 65 in the top 300
    pos = set(range(1, 62)) | {150, 160, 170} | {250} | set(range(1001, 1004))
    df = _scored(spark, 2000, pos)
    rq = queue.review_queue(df, n_buckets=8).orderBy("review_fraction").collect()
    assert [(r.reviewed_assets, r.captured_failures) for r in rq] == [(100, 61), (200, 64), (300, 65)]
    assert [r.yield_lift_vs_random for r in rq] == [17.9412, 9.4118, 6.3725]
    roi = queue.queue_roi(queue.review_queue(df)).orderBy("review_budget_pct").collect()
    assert [r.assets_per_failure_caught for r in roi] == [1.6, 3.1, 4.6]
    assert [r.yield_lift_vs_random for r in roi] == [17.94, 9.41, 6.37]


def test_cost_scenarios_golden(spark):
    b = spark.createDataFrame([(0.1, 200, 64, 68)],
                              "review_fraction double, reviewed_assets long, captured_failures long, total_failures long")
    r = economics.cost_scenarios(b).first()
    assert (r.reactive_baseline_cost, r.random_review_cost, r.risk_queue_cost, r.savings_vs_reactive) == \
        (238000, 224000, 53000, 185000)
    assert r.savings_vs_reactive_share == 0.7773


def test_per_mode_costs_golden(spark):
    modes = spark.createDataFrame(
        [("HDF", 29, 1.0), ("PWF", 13, 1.0), ("OSF", 16, 1.0), ("RNF", 4, 0.5), ("TWF", 10, 0.8)],
        "failure_code string, holdout_failures long, capture_rate double")
    out = economics.per_mode_costs(modes, 200, economics.cost_table(spark)).orderBy(F.desc("savings_vs_reactive"))
    rows = out.collect()
    assert [(r.failure_code, r.savings_vs_reactive) for r in rows] == [
        ("HDF", 91600), ("PWF", 51500), ("OSF", 26600), ("RNF", 7000), ("TWF", 2600)]
    assert sum(r.savings_vs_reactive for r in rows) == 179300


def test_confusion_to_metrics_golden(spark):
    cm = spark.createDataFrame([(1928, 4, 17, 51)], "tn long, fp long, fn long, tp long")
    r = metrics.binary_metrics_from_confusion(cm).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.9895, 0.9273, 0.75, 0.8293)


def test_mean_population_std_golden(spark):
    df = spark.createDataFrame([(v,) for v in (0.9874, 0.9755, 0.9861, 0.9861, 0.9849)], "roc_auc double")
    r = metrics.mean_and_pop_std(df, ["roc_auc"]).first()
    assert (r.roc_auc_mean, r.roc_auc_std) == (0.984, 0.0043)


def test_rul_lift_golden(spark):
    df = spark.createDataFrame([(18.0535, 49.8199, 837.6035, 166570.5426)], "m double, b double, pm double, pb double")
    r = df.select(F.round(metrics.lift_vs_baseline(F.col("m"), F.col("b")), 4).alias("a"),
                  F.round(metrics.lift_vs_baseline(F.col("pm"), F.col("pb")), 4).alias("p")).first()
    # inputs are rounded to 4 places: one unit in the last place of tolerance (FIXTURES.md)
    assert r.a == pytest.approx(63.7624, abs=1.01e-4) and r.p == pytest.approx(99.4971, abs=1.01e-4)


def test_importance_share_golden(spark):
    vals = [("f1", 0.4994), ("f2", 0.4568), ("f3", 0.2529), ("f4", 0.2091), ("f5", 0.1332), ("f6", 0.0227),
            ("f7", 0.0116), ("f8", -0.0018), ("f9", -0.0023)]
    fi = spark.createDataFrame(vals, "feature string, importance double")
    out = reports.importance_share(reports.importance_document(fi)).collect()
    assert [r.share_of_total_pct for r in out] == [31.5, 28.8, 15.9, 13.2, 8.4]
    assert [r.importance_rank for r in out] == [1, 2, 3, 4, 5]


def test_failure_mode_ranking_golden(spark):
    fm = spark.createDataFrame(
        [("HDF", "h", 29, 29, 1.0), ("OSF", "o", 16, 16, 1.0), ("PWF", "p", 13, 13, 1.0), ("TWF", "t", 10, 7, 0.7),
         ("RNF", "r", 4, 1, 0.25)],
        "failure_code string, label string, holdout_failures long, captured_in_top_10_percent_queue long, "
        "capture_rate double")
    out = reports.failure_mode_ranking(fm).collect()
    assert [r.frequency_rank for r in out] == [1, 2, 3, 4, 5]
    assert [r.capture_rate_pct for r in out] == [100.0, 100.0, 100.0, 70.0, 25.0]


def test_model_ranking_golden(spark):
    mm = spark.createDataFrame([("hgb", 0.97, 0.8518, 0.8, 0.9, 0.7), ("rf", 0.96, 0.7618, 0.7, 0.8, 0.6),
                                ("lr", 0.9, 0.3818, 0.2, 0.2, 0.8), ("prior", 0.5, 0.034, 0.0, 0.0, 0.0)],
                               "model string, roc_auc double, pr_auc double, f1 double, precision double, recall double")
    out = reports.model_ranking(mm).collect()
    assert [(r.model, r.pr_auc_rank) for r in out] == [("hgb", 1), ("rf", 2), ("lr", 3), ("prior", 4)]


@pytest.mark.parametrize("risk,rul", [(0.0, 48), (0.5, 24), (0.99, 1), (1.0, 1), (0.0104, 48), (0.3125, 33),
                                      (0.96875, 2), (0.90625, 4)])  # 1.5 -> 2 and 4.5 -> 4: half to even
def test_heuristic_rul(spark, risk, rul):
    from wearline.functions.columns import heuristic_rul
    r = spark.createDataFrame([(risk,)], "risk double").select(heuristic_rul("risk").alias("h")).first()
    expected = max(1, round(48 * (1 - risk)))  # Python round: half to even
    assert r.h == expected == rul


def test_display_labels(spark):
    from wearline.functions.columns import percent_label, thousands_label
    r = spark.createDataFrame([(0.7773, 238000)], "s double, c long").select(
        percent_label("s").alias("p"), thousands_label("c").alias("t")).first()
    assert (r.p, r.t) == ("77.7%", "238,000")


def test_band_edges(spark):
    from wearline.functions import constants as C
    from wearline.functions.columns import gauge_band, risk_band
    df = spark.createDataFrame([(v,) for v in (75.0, 75.1, 90.0, 90.1)], "x double")
    assert [r[0] for r in df.select(gauge_band("x", C.SPINDLE_BANDS, "success")).collect()] == [
        "success", "warning", "warning", "danger"]  # strict >
    rf = spark.createDataFrame([(v,) for v in (0.2999, 0.3, 0.5999, 0.6)], "r double")
    assert [r[0] for r in rf.select(risk_band("r")).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]
