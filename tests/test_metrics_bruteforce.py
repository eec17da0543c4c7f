"""Exact AUC / AP / calibration against numpy brute force; rank properties (hypothesis)."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from wearline.operators import calibration, metrics, rank


def auc_brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def ap_brute(y, s):
    if y.sum() == 0:
        return None
    total = 0.0
    for t in np.unique(s)[::-1]:
        sel = s >= t
        tp, fp = (y[sel] == 1).sum(), (y[sel] == 0).sum()
        total += ((y[s == t] == 1).sum() / y.sum()) * tp / (tp + fp)
    return total


def _df(spark, y, s):
    return spark.createDataFrame([(int(a), float(b), i) for i, (a, b) in enumerate(zip(y, s))],
                                 "y int, s double, id long")


@pytest.mark.parametrize("nb", [None, 6])
def test_auc_ap_ties(spark, nb):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.2).astype(int)
    s = np.round(rng.random(400) * 0.5 + 0.3 * y, 1)  # heavy ties
    r = metrics.ranking_metrics(_df(spark, y, s), "y", "s", n_buckets=nb).first()
    assert r.roc_auc == pytest.approx(auc_brute(y, s), abs=1e-12)
    assert r.average_precision == pytest.approx(ap_brute(y, s), abs=1e-12)
    assert (r.tp, r.fp) == (int(((s >= 0.5) & (y == 1)).sum()), int(((s >= 0.5) & (y == 0)).sum()))


def test_single_class_and_constant_scores(spark):
    one = metrics.ranking_metrics(_df(spark, np.zeros(10, int), np.arange(10) / 10), "y", "s").first()
    assert one.roc_auc is None and one.average_precision is None
    y = np.array([1, 0, 0, 1, 0])
    const = metrics.ranking_metrics(_df(spark, y, np.full(5, 0.3)), "y", "s").first()
    assert const.roc_auc == 0.5 and const.average_precision == pytest.approx(0.4)


def test_auc_invariant_under_monotone_transform(spark):
    rng = np.random.default_rng(11)
    y = (rng.random(300) < 0.3).astype(int)
    s = rng.random(300)
    a = metrics.ranking_metrics(_df(spark, y, s), "y", "s").first().roc_auc
    b = metrics.ranking_metrics(_df(spark, y, s ** 3), "y", "s").first().roc_auc
    assert a == pytest.approx(b, abs=1e-12)


def calib_numpy(p, y, n_bins=10):
    bins = np.percentile(p, np.linspace(0, 1, n_bins + 1) * 100)
    ids = np.searchsorted(bins[1:-1], p)  # left search
    tot = np.bincount(ids, minlength=len(bins))
    t = np.bincount(ids, weights=y, minlength=len(bins))
    pr = np.bincount(ids, weights=p, minlength=len(bins))
    nz = tot != 0
    return t[nz] / tot[nz], pr[nz] / tot[nz]


@pytest.mark.parametrize("nb", [None, 5])
def test_calibration_matches_numpy(spark, nb):
    rng = np.random.default_rng(5)
    p = np.round(rng.beta(0.5, 5, 1000), 3)
    y = (rng.random(1000) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "risk double, machine_failure int")
    bins = calibration.calibration_bins(df, n_buckets=nb).orderBy("bin").collect()
    fp, mp = calib_numpy(p, y)
    assert len(bins) == len(fp)
    assert [b.actual_failure_rate for b in bins] == pytest.approx(list(fp), abs=1e-12)
    assert [b.predicted_probability_bin for b in bins] == pytest.approx(list(mp), abs=1e-12)
    ece = calibration.expected_calibration_error(df, n_buckets=nb).first().expected_calibration_error
    assert ece == round(float(np.mean(np.abs(fp - mp))), 4)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-3, 3)), min_size=1, max_size=60))
def test_bucketed_rank_equals_row_number(spark, rows):
    df = spark.createDataFrame([(g, float(v), i) for i, (g, v) in enumerate(rows)], "g int, v double, id long")
    want = df.withColumn("rn", F.row_number().over(
        Window.partitionBy("g").orderBy(F.col("v").desc(), "id")).cast("bigint"))
    got = rank.global_row_number(df, "v", descending=True, tie="id", by=["g"], n_buckets=4)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_global_rank_heavy_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.rand(1)).alias("v"))
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("v").desc(), "id")).cast("bigint"))
    got = rank.global_row_number(df, "v", descending=True, tie="id", n_buckets=8)
    assert got.exceptAll(want).count() == 0
    sizes = rank.add_order_buckets(df, "v", descending=True, tie="id", n_buckets=8).groupBy("_wl_bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 1000  # the value holding a third is split


def test_exact_quantiles_vs_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 4).alias("g"), F.round(F.rand(3) * 100, 0).alias("x"))
    fr = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in rank.exact_quantiles(df, "x", fr, by=["g"], n_buckets=7).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", fr).alias("q")).collect()}
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9)


@pytest.mark.parametrize("nb", [3, 8])
def test_queue_selection_equals_full_rank(spark, nb):
    from wearline.operators import queue
    from wearline.sources.adapters import readings
    r = readings(spark, "/root/testdata/sf0.001")
    r = r.withColumn("risk", F.when(F.col("product_id") % 3 == 0, F.lit(0.5)).otherwise(F.col("risk")))  # hot value
    fr = [0.001, 0.05, 0.1, 0.15, 0.5, 1.0]
    a = queue.queue_counts_by_selection(r, fr, extra_flags=["twf"], n_buckets=nb).orderBy("review_fraction").collect()
    ranked, n = queue.rank_queue(r.select("product_id", "risk", "machine_failure", "twf"))
    b = queue.queue_counts(ranked, n, fr, "machine_failure", ["twf"]).orderBy("review_fraction").collect()
    assert [tuple(x) for x in a] == [tuple(y) for y in b]
