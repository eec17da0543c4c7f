"""Model workflows on sf0.001: splits, folds, fits, importance (properties, not values)."""

from pyspark.sql import functions as F

from tests.conftest import SF001
from wearline.ml import estimators as P
from wearline.ml import workflows as W
from wearline.ml.importance import permutation_importance
from wearline.ml.split import group_folds, stratified_folds, stratified_split
from wearline.operators.features import add_derived_features
from wearline.sources.adapters import CATEGORICAL_FEATURES, DERIVED_FEATURES, NUMERIC_FEATURES, cycles, readings

ENH = NUMERIC_FEATURES + DERIVED_FEATURES


def test_split_keeps_class_rate(spark):
    r = readings(spark, SF001)
    s = stratified_split(r, n_buckets=4).groupBy("machine_failure").agg(F.avg("is_test").alias("t"), F.count("*").alias("n"))
    for row in s.collect():
        assert abs(row.t - 0.2) <= 1.0 / row.n + 1e-9


def test_folds(spark):
    r = stratified_split(readings(spark, SF001)).filter("is_test = 0")
    f = stratified_folds(r, n_buckets=4)
    sizes = [x["count"] for x in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2
    g = group_folds(cycles(spark, SF001))
    assert g.groupBy("unit_number").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0


def test_fit_score_and_importance(spark):
    df = add_derived_features(readings(spark, SF001))
    train, test = W.split_frames(df)
    model, scored, _ = W.fit_score("logistic", train, test, ENH, CATEGORICAL_FEATURES, maxIter=50)
    assert scored.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    imp = permutation_importance(model, test.select("product_id", "machine_failure", *CATEGORICAL_FEATURES, *ENH),
                                 ["torque_nm", "rpm"], repeats=2)
    assert imp.count() == 2


def test_model_persistence(spark, scratch):
    df = add_derived_features(readings(spark, SF001))
    train, test = W.split_frames(df)
    model, scored, _ = W.fit_score("logistic", train, test, ENH, CATEGORICAL_FEATURES, maxIter=20)
    P.save(model, scratch + "/m")
    again = P.positive_probability(P.load(scratch + "/m").transform(test))
    a = {r.product_id: r.score for r in scored.select("product_id", "score").collect()}
    b = {r.product_id: r.score for r in again.select("product_id", "score").collect()}
    assert a == b


def test_fingerprint_order_free(spark):
    r = readings(spark, SF001)
    a = W.fingerprint(r).first()
    b = W.fingerprint(r.orderBy(F.rand(3))).first()
    assert a.rows == b.rows and a.sha256 == b.sha256


def test_fingerprint_tells_rows_apart(spark):
    def of(*rows):
        return W.fingerprint(spark.createDataFrame(list(rows), "a string, b string, x double, n long")).first().sha256

    one = ("a", "b", 1.0000001, 1)
    others = [("a|b", "", 1.0000001, 1), ("ab", "", 1.0000001, 1), ("", "ab", 1.0000001, 1), ("a", "b", 1.0000004, 1), ("a", "b", 1.0000001 + 2**-52, 1), ("a", None, 1.0000001, 1),
              ("a", "", 1.0000001, 1), ("a", "b", -1.0000001, 1), ("a", "b", None, 1), ("a", "b", float("nan"), 1), ("a", "b", float("inf"), 1), ("a", "b", 5e-324, 1), ("a", "b", 1e308, 1),
              ("a", "b", 0.0, 1), ("a", "b", 1.0, 1), ("a", "b", 2.0, 1), ("a", "b", 1.0000001, None), ("1", "b", 1.0000001, 1), ("é", "b", 1.0000001, 1)]
    seen = [of(one), *[of(o) for o in others], of(one, one), of(one, others[0])]
    assert len(set(seen)) == len(seen) and of(one, others[0]) == of(others[0], one) and of(("a", "b", -0.0, 1)) == of(("a", "b", 0.0, 1))


def test_group_folds_are_of_even_size(spark):
    sizes = [1, 40, 3, 3, 17, 8, 8, 8, 2, 29, 5, 5, 11, 1, 1, 6, 30, 9, 4, 12, 13]
    df = spark.createDataFrame([(u if u else None, i) for u, n in enumerate(sizes) for i in range(n)], "unit_number long, t long")
    out = group_folds(df)
    assert out.count() == sum(sizes) and out.groupBy("unit_number").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0
    rows = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(rows) == 5 and max(rows) - min(rows) <= max(sizes)
    assert group_folds(df.limit(0)).count() == 0


def test_sampled_shapley_sums_to_score_gap(spark):
    from wearline.ml.shapley import sampled_shapley
    from wearline.ml.split import background_sample
    df = add_derived_features(readings(spark, SF001))
    train, test = W.split_frames(df)
    model, scored, _ = W.fit_score("boosting", train, test, ENH, CATEGORICAL_FEATURES, weight=None, maxIter=5)
    top = scored.orderBy(F.col("score").desc(), "product_id").limit(3).select("product_id", *CATEGORICAL_FEATURES, *ENH)
    bg = background_sample(train.select("product_id", *CATEGORICAL_FEATURES, *ENH), 50)
    sh = sampled_shapley(model, top, bg, ENH + CATEGORICAL_FEATURES, samples=16)
    per = sh.groupBy("product_id").agg(F.sum("contribution").alias("s"), F.first("base_value").alias("b"),
                                       F.first("predicted_probability").alias("p")).collect()
    assert len(per) == 3
    want = {r.product_id: r.score for r in scored.select("product_id", "score").collect()}
    for r in per:
        assert abs(r.s - (r.p - r.b)) < 1e-9  # telescoping: contributions sum to f(x) - base
        assert abs(r.p - want[r.product_id]) < 1e-9  # the all-x coalition is the row itself
