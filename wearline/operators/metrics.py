"""Classification and regression metrics as grouped aggregates.

A4 confusion matrix, A5 accuracy/precision/recall/F1, A6 tie-aware ROC-AUC,
A7 average precision (step sum), A26 one metric row per model, A17 mean and
population std, A9 RMSE, A10 PHM08, A12 lift.

AUC and AP collapse the scored rows to one row per distinct score first
(a partial+final aggregate), then take exact running sums over the scores with the
bucketed prefix sum of ``wearline.operators.rank`` — no single-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import decision, round4, safe_div, safe_div0
from wearline.operators.rank import cleaned, running_sums


def confusion(scored: DataFrame, label: str = "machine_failure", score: str = "risk",
              by: list[str] | tuple = (), threshold: float = C.DECISION_THRESHOLD) -> DataFrame:
    """A4: fixed 2x2 layout as columns tn, fp, fn, tp (bigint), zero when a class is absent."""
    pred = decision(F.col(score), threshold)
    y = F.col(label)

    def cell(yv, pv):
        return F.sum(F.when((y == yv) & (pred == pv), 1).otherwise(0)).cast("bigint")

    return scored.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                   cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def binary_metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """A5: accuracy, precision, recall, F1 (zero-division -> 0), rounded to 4 places."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision = safe_div0(tp, tp + fp)
    recall = safe_div0(tp, tp + fn)
    f1 = safe_div0(2 * tp, 2 * tp + fp + fn)
    keep = [c for c in cm.columns if c not in ("tn", "fp", "fn", "tp")]
    return cm.select(*keep, "tn", "fp", "fn", "tp",
                     round4(safe_div0(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
                     round4(precision).alias("precision"), round4(recall).alias("recall"),
                     round4(f1).alias("f1"))


def _score_counts(scored: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    y = F.col(label).cast("bigint")
    scored = scored.withColumn(score, cleaned(scored, score))
    return (scored.filter(F.col(score).isNotNull())
            .groupBy(*by, score)
            .agg(F.sum(y).alias("_pos"), F.sum(F.lit(1) - y).alias("_neg")))


def ranking_metrics(scored: DataFrame, label: str = "machine_failure", score: str = "risk",
                    by: list[str] | tuple = (), threshold: float = C.DECISION_THRESHOLD,
                    n_buckets: int | None = None, n_rows: int | None = None) -> DataFrame:
    """Confusion cells, ROC-AUC and AP in one pass over the distinct scores.

    1. collapse to one row per (group, score): positives, negatives (partial+final agg);
    2. one running sum in descending score order: ctp, cfp (bucketed when large);
    3. one aggregate:
       AUC = 1 - sum(pos * (cfp - neg / 2)) / (P * N)  (negatives above plus half the tied),
       AP  = sum(pos * ctp / (ctp + cfp)) / P           (step sum over distinct thresholds),
       tp/fp = positives/negatives with score >= threshold, fn = P - tp, tn = N - fp.
    The input row count bounds the number of distinct scores, so it sizes the buckets.
    """
    by = list(by)
    if n_buckets is None and n_rows is None:
        n_rows = scored.count()
    sc = _score_counts(scored, label, score, by)
    cum = running_sums(sc, score, {"_ctp": "_pos", "_cfp": "_neg"}, descending=True, by=by,
                       n_buckets=n_buckets, n_rows=n_rows)
    hit = F.col(score) >= F.lit(threshold)
    agg = cum.groupBy(*by).agg(
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"),
        F.sum(F.col("_pos") * (F.col("_cfp") - F.col("_neg") / 2.0)).alias("_mis"),
        F.sum(F.col("_pos") * (F.col("_ctp") / (F.col("_ctp") + F.col("_cfp")).cast("double"))).alias("_apn"),
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, F.col("_neg")).otherwise(0)).alias("_fp"))
    p, n = F.col("_p"), F.col("_n")
    return agg.select(
        *by,
        (n - F.col("_fp")).cast("bigint").alias("tn"), F.col("_fp").cast("bigint").alias("fp"),
        (p - F.col("_tp")).cast("bigint").alias("fn"), F.col("_tp").cast("bigint").alias("tp"),
        F.when((p > 0) & (n > 0), F.lit(1.0) - F.col("_mis") / (p * n).cast("double")).alias("roc_auc"),
        F.when(p > 0, F.col("_apn") / p.cast("double")).alias("average_precision"))


def roc_auc(scored: DataFrame, label: str = "machine_failure", score: str = "risk",
            by: list[str] | tuple = (), n_buckets: int | None = None) -> DataFrame:
    """Exact tie-aware ROC-AUC (NULL when one class is absent), unrounded ``roc_auc``."""
    return ranking_metrics(scored, label, score, by, n_buckets=n_buckets).select(*by, "roc_auc")


def average_precision(scored: DataFrame, label: str = "machine_failure", score: str = "risk",
                      by: list[str] | tuple = (), n_buckets: int | None = None) -> DataFrame:
    """Step-sum average precision (NULL without positives), unrounded ``average_precision``."""
    return ranking_metrics(scored, label, score, by, n_buckets=n_buckets).select(*by, "average_precision")


def model_metrics(scored: DataFrame, label: str = "machine_failure", score: str = "risk",
                  by: list[str] | tuple = ("model",), n_buckets: int | None = None) -> DataFrame:
    """One row per group with accuracy, roc_auc, pr_auc, precision, recall, f1 (4 places)."""
    by = list(by)
    rm = ranking_metrics(scored, label, score, by, n_buckets=n_buckets)
    cm = binary_metrics_from_confusion(rm)
    return cm.select(*by, "accuracy", round4("roc_auc").alias("roc_auc"),
                     round4("average_precision").alias("pr_auc"), "precision", "recall", "f1")


def mean_and_pop_std(df: DataFrame, cols: list[str], by: list[str] | tuple = ()) -> DataFrame:
    """Mean and population std (np.std) per column."""
    aggs = []
    for c in cols:
        aggs += [round4(F.avg(c)).alias(f"{c}_mean"), round4(F.stddev_pop(c)).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)


def regression_scores(df: DataFrame, truth: str, pred: str, by: list[str] | tuple = ()) -> DataFrame:
    """A9 RMSE and A10 PHM08 score (d = pred - truth; exp(-d/13)-1 early, exp(d/10)-1 late)."""
    d = F.col(pred).cast("double") - F.col(truth).cast("double")
    phm = F.when(d < 0, F.exp(-d / C.PHM08_EARLY_DIVISOR) - 1.0).otherwise(F.exp(d / C.PHM08_LATE_DIVISOR) - 1.0)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"),
                               F.sqrt(F.avg(d * d)).alias("rmse"), F.sum(phm).alias("phm08_score"))


def lift_vs_baseline(model_value: F.Column, baseline_value: F.Column) -> F.Column:
    """Percent improvement of the model over the baseline (0 when the baseline is 0)."""
    return safe_div0(baseline_value - model_value, baseline_value) * 100.0


__all__ = ["confusion", "binary_metrics_from_confusion", "roc_auc", "average_precision",
           "model_metrics", "ranking_metrics", "mean_and_pop_std", "regression_scores", "lift_vs_baseline", "safe_div"]
