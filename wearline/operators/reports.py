"""Report operators over small result tables (the reference's four SQL queries).

Q1 failure modes ranked by holdout frequency, Q2 models ranked by PR-AUC, Q3 queue
ROI (in ``queue.queue_roi``), Q4 share of positive importance. Windows here have no
partition on purpose: they run over a handful of result rows, never over data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def failure_mode_ranking(fm: DataFrame) -> DataFrame:
    """Q1 over (failure_code, label, holdout_failures, captured, capture_rate)."""
    w = Window.orderBy(F.col("holdout_failures").desc())
    return fm.select(
        "failure_code", "label", "holdout_failures",
        F.col("captured_in_top_10_percent_queue").alias("captured_top10"),
        F.round(F.col("capture_rate") * 100, 1).alias("capture_rate_pct"),
        F.rank().over(w).cast("bigint").alias("frequency_rank"),
    ).orderBy(F.col("holdout_failures").desc())


def model_ranking(mm: DataFrame) -> DataFrame:
    """Q2 over per-model metrics (model, roc_auc, pr_auc, f1, precision, recall)."""
    w = Window.orderBy(F.col("pr_auc").desc())
    return mm.select("model", F.round("roc_auc", 4).alias("roc_auc"), F.round("pr_auc", 4).alias("pr_auc"),
                     F.round("f1", 4).alias("f1"), F.round("precision", 4).alias("precision_score"),
                     F.round("recall", 4).alias("recall_score"),
                     F.rank().over(w).cast("bigint").alias("pr_auc_rank")).orderBy(F.col("pr_auc").desc())


def importance_document(fi: DataFrame) -> DataFrame:
    """One row holding ``features: array<struct<feature, importance>>`` (the artifact shape);
    one entry per model feature, a fixed handful."""
    return fi.agg(F.sort_array(F.collect_list(F.struct("feature", "importance"))).alias("features"))


def importance_share(doc: DataFrame, top: int = 5) -> DataFrame:
    """Q4: unnest the document (J2), positive part (P8), share of the positive total (J1,
    A19), rank by importance and keep the top ``top`` (T2)."""
    fi = doc.select(F.inline("features")).withColumn(
        "positive_importance", F.when(F.col("importance") > 0, F.col("importance")).otherwise(F.lit(0.0)))
    total = fi.agg(F.sum("positive_importance").alias("total_pos"))
    w = Window.orderBy(F.col("importance").desc())
    out = fi.crossJoin(F.broadcast(total)).select(  # one-row total: proven bound
        "feature", F.round("importance", 4).alias("importance"),
        F.round(F.col("positive_importance") / F.nullif(F.col("total_pos"), F.lit(0.0)) * 100, 1)
        .alias("share_of_total_pct"),
        F.rank().over(w).cast("bigint").alias("importance_rank"), F.col("importance").alias("_imp"))
    return out.orderBy(F.col("_imp").desc()).limit(top).drop("_imp")
