"""A8 calibration curve with quantile bins and the expected calibration error.

Edges are the exact linear-interpolation quantiles of the scores (selection, no
sort); a score's bin is the number of interior edges strictly below it (a left
search); empty bins vanish, so tied edges collapse bins. ECE is the plain mean
of |actual - predicted| over the non-empty bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions.columns import round4
from wearline.operators.rank import cleaned, exact_quantiles, join_groups, quantile_grid


def calibration_bins(scored: DataFrame, score: str = "risk", label: str = "machine_failure",
                     n_bins: int = 10, by: list[str] | tuple = (), n_buckets: int | None = None) -> DataFrame:
    """Unrounded per-bin rows: ``bin, n, predicted_probability_bin, actual_failure_rate``."""
    by = list(by)
    fr = quantile_grid(n_bins, percent=True)
    edges = exact_quantiles(scored, score, fr, by=by, out="_edges", n_buckets=n_buckets)
    interior = F.slice("_edges", 2, n_bins - 1)
    e = edges.select(*by, interior.alias("_int"))
    scored = scored.withColumn(score, cleaned(scored, score)).filter(F.col(score).isNotNull())
    joined = join_groups(scored, e, by) if by else scored.crossJoin(F.broadcast(e))  # one row
    binned = joined.withColumn("bin", F.size(F.filter("_int", lambda x: x < F.col(score))))
    return (binned.groupBy(*by, "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(score)).alias("predicted_probability_bin"),
                 F.avg(F.col(label).cast("double")).alias("actual_failure_rate")))


def calibration_curve(scored: DataFrame, score: str = "risk", label: str = "machine_failure",
                      n_bins: int = 10, by: list[str] | tuple = (), n_buckets: int | None = None) -> DataFrame:
    bins = calibration_bins(scored, score, label, n_bins, by, n_buckets)
    return bins.select(*by, F.col("bin").cast("bigint").alias("bin"),
                       round4("predicted_probability_bin").alias("predicted_probability_bin"),
                       round4("actual_failure_rate").alias("actual_failure_rate"),
                       round4(F.col("actual_failure_rate") - F.col("predicted_probability_bin"))
                       .alias("calibration_gap"))


def expected_calibration_error(scored: DataFrame, score: str = "risk", label: str = "machine_failure",
                               n_bins: int = 10, by: list[str] | tuple = (),
                               n_buckets: int | None = None) -> DataFrame:
    bins = calibration_bins(scored, score, label, n_bins, by, n_buckets)
    gap = F.abs(F.col("actual_failure_rate") - F.col("predicted_probability_bin"))
    return bins.groupBy(*by).agg(F.lit(n_bins).cast("bigint").alias("n_bins"),
                                 F.count(F.lit(1)).alias("non_empty_bins"),
                                 round4(F.avg(gap)).alias("expected_calibration_error"))
