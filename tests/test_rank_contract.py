"""One ordering contract: equal results for 1, 8 and 64 buckets with NaN, NULL, string ids, heavy ties
and empty input."""

import random

import pytest
from pyspark.sql import functions as F

from wearline.ml import split
from wearline.operators import calibration, drift, metrics, queue, rank, telemetry

NAN = float("nan")


def scored(spark, strings: bool):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        score = [NAN, None, 0.5, 0.5, -0.0, 0.0, rnd.random(), rnd.random()][i % 8]
        rows.append((f"L{i * 37 % 1000:04d}" if strings else i * 37 % 1000, score, int(rnd.random() < 0.2), rnd.random() * 1e6))
    kind = "string" if strings else "long"
    return spark.createDataFrame(rows, f"product_id {kind}, risk double, machine_failure int, amount double")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("strings", [False, True])
def test_every_operator_agrees_with_itself(spark, strings):
    df = scored(spark, strings)
    group = df.withColumn("g", F.when(F.col("machine_failure") == 0, F.lit("a")))  # NULL group too
    def ops(p):
        return {
            "rank": rank.global_row_number(df, "risk", descending=True, tie="product_id", n_buckets=p).select("product_id", "rn"),
            "string order": rank.global_row_number(df, "product_id", by=["machine_failure"], n_buckets=p).select("product_id", "rn"),
            "null groups": rank.global_row_number(group, "risk", tie="product_id", by=["g"], n_buckets=p).select("product_id", "g", "rn"),
            "sums": rank.running_sums(df, "risk", {"s": "amount", "k": "machine_failure"}, tie="product_id", n_buckets=p).select("product_id", "s", "k"),
            "W5": queue.review_queue(df, n_buckets=p),
            "W10": queue.capture_curve(df, [0.1, 0.5], n_buckets=p),
            "A6 A7": metrics.ranking_metrics(df, n_buckets=p),
            "A8": calibration.calibration_curve(df, n_buckets=p),
            "F7": rank.exact_quantiles(df, "amount", rank.quantile_grid(10, True), n_buckets=p),
            "A14": drift.numeric_psi(df, df.filter("machine_failure = 0"), ["risk", "amount"], n_buckets=p),
            "U4": drift.bootstrap_sample(df.drop("risk"), 40, n_buckets=p),
            "M1": split.stratified_split(group.select("product_id", "g"), "g", "product_id", n_buckets=p).select("product_id", "g", "is_test"),
        }
    want = {k: rows_of(v) for k, v in ops(1).items()}
    for p in (8, 64):
        got = {k: rows_of(v) for k, v in ops(p).items()}
        for k in want:
            if k in ("A6 A7", "A8"):  # averages of doubles
                assert [tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in got[k]] == [
                    tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in want[k]], (k, p)
            elif k == "A14":
                assert [(f, round(x, 12)) for f, x in got[k]] == [(f, round(x, 12)) for f, x in want[k]], (k, p)
            else:
                assert got[k] == want[k], (k, p)
    assert len(want["M1"]) == len(want["null groups"]) == 300


@pytest.mark.parametrize("p", [1, 8])
def test_nan_and_null_come_last_and_empty_input(spark, p):
    df = spark.createDataFrame([(1, NAN), (2, None), (3, 1.0), (4, 2.0)], "id long, v double")
    down = {r.id: r.rn for r in rank.global_row_number(df, "v", descending=True, tie="id", n_buckets=p).collect()}
    up = {r.id: r.rn for r in rank.global_row_number(df, "v", tie="id", n_buckets=p).collect()}
    assert down == {4: 1, 3: 2, 1: 3, 2: 4} and up == {3: 1, 4: 2, 1: 3, 2: 4}
    none = df.limit(0)
    assert rank.global_row_number(none, "v", n_buckets=p).count() == 0
    assert rank.running_sums(none, "v", {"s": "v"}, tie="id", n_buckets=p).count() == 0
    assert rank.exact_quantiles(none, "v", [0.5], n_buckets=p).count() == 0
    empty = scored(spark, True).limit(0)
    assert queue.review_queue(empty, n_buckets=p).count() == 0


@pytest.mark.parametrize("p", [1, 2, 8, 64])
def test_wear_with_reset_over_buckets(spark, p):
    rnd = random.Random(3)
    rows = [(m, t, rnd.random() < 0.05, None if t % 11 == 0 else rnd.random()) for m in (1, 2, None) for t in range(200 if m == 1 else 40)]
    df = spark.createDataFrame(rows, "machine_id long, ts long, tool_change boolean, wear_inc double").withColumn("tick_id", F.col("ts"))
    want, wear = {}, {}
    for m, t, change, inc in rows:
        wear[m] = 0.0 if change else wear.get(m, 0.0) + round(inc or 0.0, 12)
        want[m, t] = wear[m]
    got = {(r.machine_id, r.ts): r.tool_wear_min for r in telemetry.wear_with_reset(df, n_buckets=p).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nan_in_psi_counts_as_null(spark):
    base = spark.range(2000).select((F.col("id") % 97).cast("double").alias("x"))
    def with_(v):
        return base.withColumn("x", F.when(F.rand(1) < 0.25, F.lit(v).cast("double")).otherwise(F.col("x")))
    a, b = (drift.numeric_psi(base, with_(v), ["x"]).first().psi for v in (NAN, None))
    assert a == b < 0.05


def test_null_groups_and_null_keys_at_every_size(spark):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2], None if i == 7 else float(i), i % 4 == 0) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, g string, v double, y boolean").withColumn("y", F.col("y").cast("int"))
    def ops(p):
        return {
            "quantiles": rank.exact_quantiles(df, "v", [0.0, 0.3, 1.0], by=["g"], n_buckets=p),
            "calibration": calibration.calibration_bins(df, "v", "y", 3, ["g"], n_buckets=p).select("g", "bin", "n"),
            "rolling": rank.rolling_window(df, "v", lambda w: {"s": F.sum("id").over(w)}, 3, ["g"], n_buckets=p).select("id", "g", "s"),
        }
    want = {k: sorted(map(repr, v.collect())) for k, v in ops(1).items()}
    assert [sum("g=None" in r for r in want[k]) for k in want] == [1, 3, 30] and any("id=7, g='b', s=181" in r for r in want["rolling"])
    assert {k: sorted(map(repr, v.collect())) for k, v in ops(8).items()} == want


@pytest.mark.parametrize("p", [1, 8])
def test_sums_of_any_size(spark, p):
    """Values beyond decimals count in running and in segmented sums, at every size."""
    rows = [(i, v) for i, v in enumerate([1.0, 1e27, 2.0, None, 1e-15, NAN, -1e27, 0.25, float("inf")])]
    df = spark.createDataFrame(rows, "k long, v double").withColumn("r", F.col("k") == -1)
    run = [r.s for r in rank.running_sums(df, "k", {"s": "v"}, n_buckets=p).orderBy("k").collect()]
    seg = [r.s for r in rank.segmented_sum(df, "k", "v", "r", "s", n_buckets=p).orderBy("k").collect()]
    assert run == seg == [1.0, 1e27, 1e27, 1e27, 1e27, 1e27, 3.0, 3.25, float("inf")]
    tiny = spark.createDataFrame([(i, 1e-15) for i in range(20)], "k long, v double")
    assert max(r.s for r in rank.running_sums(tiny, "k", {"s": "v"}, n_buckets=p).collect()) == pytest.approx(2e-14)
    late = spark.createDataFrame([(0, None), (1, 4.0)], "k long, v double")
    assert [r.s for r in rank.running_sums(late, "k", {"s": "v"}, n_buckets=p).orderBy("k").collect()] == [None, 4.0]


@pytest.mark.parametrize("window", [1, 2, 5, 40])
def test_rolling_frames_over_short_buckets(spark, window):
    """Frames longer than the buckets they reach into, over groups of one row and of many."""
    rows = [(g, i) for g, n in (("a", 60), ("b", 1), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long")
    want = {(g, i): sum(range(max(0, i - window + 1), i + 1)) for g, i in rows}
    for p in (1, 7, 64):
        out = rank.rolling_window(df, "k", lambda w: {"s": F.sum("k").over(w)}, window, ["g"], n_buckets=p)
        assert {(r.g, r.k): r.s for r in out.collect()} == want and out.columns == ["g", "k", "s"]
