"""PSI cases taken from the reference's tests, plus a numpy brute-force oracle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import drift


def _psi_numpy(ref, cur, buckets=10, eps=1e-4):
    ref = ref[~np.isnan(ref)]
    cur = cur[~np.isnan(cur)]
    if len(ref) == 0 or len(cur) == 0:
        return 0.0
    import pandas as pd
    bp = np.unique(pd.Series(ref).quantile(np.linspace(0, 1, buckets + 1)).values)  # as the reference computes it
    if len(bp) < 3:
        return 0.0
    bp[0], bp[-1] = -np.inf, np.inf
    r, _ = np.histogram(ref, bins=bp)
    c, _ = np.histogram(cur, bins=bp)
    r = np.clip(r / max(len(ref), 1), eps, None)
    c = np.clip(c / max(len(cur), 1), eps, None)
    return float(np.sum((c - r) * np.log(c / r)))


def _frames(spark, a, b, col="x"):
    return (spark.createDataFrame([(float(v),) for v in a], f"{col} double"),
            spark.createDataFrame([(float(v),) for v in b], f"{col} double"))


@pytest.mark.parametrize("psi,verdict", [(0.05, "no_significant_drift"), (0.15, "moderate_drift"),
                                         (0.25, "significant_drift")])
def test_verdict_bands(spark, psi, verdict):
    from wearline.functions.columns import psi_verdict
    assert spark.createDataFrame([(psi,)], "p double").select(psi_verdict("p")).first()[0] == verdict


def test_same_normal_low_psi(spark):
    rng = np.random.default_rng(42)
    a, b = rng.normal(50, 5, 2000), rng.normal(50, 5, 2000)
    r, c = _frames(spark, a, b)
    got = drift.numeric_psi(r, c, ["x"]).first().psi
    assert got < 0.05
    assert got == pytest.approx(_psi_numpy(a, b), abs=1e-9)


def test_shifted_normal_high_psi(spark):
    rng = np.random.default_rng(42)
    a, b = rng.normal(50, 5, 2000), rng.normal(90, 5, 2000)
    r, c = _frames(spark, a, b)
    got = drift.numeric_psi(r, c, ["x"], n_buckets=8).first().psi  # distributed quantile path
    assert got > 0.2
    assert got == pytest.approx(_psi_numpy(a, b), abs=1e-9)


def test_categorical_same_and_swapped(spark):
    ref = ["L"] * 600 + ["M"] * 300 + ["H"] * 100
    swapped = ["L"] * 100 + ["M"] * 300 + ["H"] * 600
    r = spark.createDataFrame([(v,) for v in ref], "t string")
    same = drift.categorical_psi(r, r, ["t"]).first().psi
    sw = drift.categorical_psi(r, spark.createDataFrame([(v,) for v in swapped], "t string"), ["t"]).first().psi
    assert same < 0.01 and sw > 0.2


def test_edge_cases(spark):
    # fewer than 3 unique breakpoints -> 0; an empty side -> 0; nulls dropped
    a = [1.0] * 50 + [2.0] * 51  # breakpoints {1, 2}: fewer than 3
    r, c = _frames(spark, a, [5.0] * 10)
    assert drift.numeric_psi(r, c, ["x"]).first().psi == 0.0 == _psi_numpy(np.array(a), np.array([5.0] * 10))
    a3 = [1.0] * 50 + [2.0] * 50  # the median interpolates to 1.5: three breakpoints
    r3, c3 = _frames(spark, a3, [5.0] * 10)
    assert drift.numeric_psi(r3, c3, ["x"]).first().psi == pytest.approx(_psi_numpy(np.array(a3), np.array([5.0] * 10)))
    r2 = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "x double")
    c2 = spark.createDataFrame([(None,)], "x double")
    assert drift.numeric_psi(r2, c2, ["x"]).first().psi == 0.0


def test_random_against_numpy(spark):
    rng = np.random.default_rng(7)
    for _ in range(3):
        a = np.round(rng.gamma(2.0, 3.0, 500), 1)  # ties
        b = np.round(rng.gamma(2.5, 3.0, 300), 1)
        r, c = _frames(spark, a, b)
        assert drift.numeric_psi(r, c, ["x"]).first().psi == pytest.approx(_psi_numpy(a, b), abs=1e-9)


def test_bootstrap_sample_exact_n(spark):
    df = spark.range(1, 501).withColumnRenamed("id", "product_id")
    s = drift.bootstrap_sample(df, 1000, seed=42, n_buckets=4)
    assert s.count() == 1000
    assert s.select("product_id").distinct().count() < 500  # with replacement
    assert s.groupBy().agg(F.min("product_id"), F.max("product_id")).first()[0] >= 1


def test_merged_pass_equals_separate(spark):
    rng = np.random.default_rng(9)
    a = [(float(x), str(c)) for x, c in zip(np.round(rng.normal(0, 1, 400), 2), rng.choice(list("LMH"), 400))]
    b = [(float(x), str(c)) for x, c in zip(np.round(rng.normal(0.5, 1, 300), 2), rng.choice(list("LMHX"), 300))]
    b += [(None, None)] * 5
    r = spark.createDataFrame(a, "x double, t string")
    c = spark.createDataFrame(b, "x double, t string")
    merged = {row.feature: row.psi for row in drift.psi_all(r, c, ["x"], ["t"]).collect()}
    assert merged["x"] == pytest.approx(drift.numeric_psi(r, c, ["x"]).first().psi, abs=1e-12)
    assert merged["t"] == pytest.approx(drift.categorical_psi(r, c, ["t"]).first().psi, abs=1e-12)
    assert merged["x"] == pytest.approx(_psi_numpy(np.array([v for v, _ in a]), np.array([v for v, _ in b[:-5]])), abs=1e-9)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=3, max_size=80), st.lists(st.integers(0, 20), min_size=1, max_size=80))
def test_psi_properties(spark, a, b):
    r, c = _frames(spark, a, b)
    same = drift.psi_all(r, r, ["x"], []).first().psi
    other = drift.psi_all(r, c, ["x"], []).first().psi
    assert same == 0.0
    assert other >= 0.0
    assert other == pytest.approx(_psi_numpy(np.array(a, float), np.array(b, float)), abs=1e-9)
