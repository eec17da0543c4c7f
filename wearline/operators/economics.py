"""A21 three-scenario cost simulation and A22 per-mode cost model (J4 cost lookup)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import failure_label, round4, safe_div0


def cost_table(spark: SparkSession, costs: dict | None = None) -> DataFrame:
    """The per-mode cost assumptions as a 5-row dimension table."""
    costs = costs or C.FAILURE_MODE_COSTS
    rows = [(k, int(v["unplanned_cost"]), int(v["preventive_cost"])) for k, v in costs.items()]
    return spark.createDataFrame(rows, "failure_code string, unplanned_cost bigint, preventive_cost bigint")


def cost_scenarios(budget: DataFrame, review_cost: int = C.REVIEW_COST_PER_ASSET,
                   preventive_cost: int = C.PREVENTIVE_MAINTENANCE_COST,
                   unplanned_cost: int = C.UNPLANNED_FAILURE_COST) -> DataFrame:
    """A21 from the primary budget row (``review_fraction, reviewed_assets,
    captured_failures, total_failures``): reactive, random review and risk queue costs.

    Random review captures round_half_even(total * fraction) failures, as the reference."""
    tot = F.col("total_failures")
    cap = F.col("captured_failures")
    rev = F.col("reviewed_assets")
    reactive = tot * unplanned_cost
    queue_cost = rev * review_cost + cap * preventive_cost + (tot - cap) * unplanned_cost
    rnd = F.bround(tot.cast("double") * F.col("review_fraction"), 0).cast("bigint")
    random_cost = rev * review_cost + rnd * preventive_cost + (tot - rnd) * unplanned_cost
    return budget.select(
        reactive.cast("bigint").alias("reactive_baseline_cost"),
        random_cost.cast("bigint").alias("random_review_cost"),
        queue_cost.cast("bigint").alias("risk_queue_cost"),
        (reactive - queue_cost).cast("bigint").alias("savings_vs_reactive"),
        round4(safe_div0(reactive - queue_cost, reactive)).alias("savings_vs_reactive_share"),
    )


def per_mode_costs(modes: DataFrame, reviewed_assets: F.Column | int, costs: DataFrame,
                   review_cost: int = C.REVIEW_COST_PER_ASSET, share_review_cost: bool = True) -> DataFrame:
    """Per failure mode (``failure_code, holdout_failures, capture_rate``) the costs
    and savings; captured = round_half_even(holdout * capture_rate).

    ``share_review_cost=True`` keeps the reference behaviour: the whole queue's review
    cost is charged to every mode. ``False`` splits it evenly over the modes.
    """
    j = modes.join(F.broadcast(costs), "failure_code", "inner")  # 5-row dimension
    rev = reviewed_assets if isinstance(reviewed_assets, F.Column) else F.lit(int(reviewed_assets))
    hold = F.col("holdout_failures")
    captured = F.bround(hold.cast("double") * F.col("capture_rate"), 0).cast("bigint")
    j = j.withColumn("captured_failures", captured).withColumn("missed_failures", hold - F.col("captured_failures"))
    review = rev * review_cost
    if not share_review_cost:
        review = review / F.count(F.lit(1)).over(Window.partitionBy())  # one row per mode
    reactive = hold * F.col("unplanned_cost")
    queue_cost = (review + F.col("captured_failures") * F.col("preventive_cost")
                  + F.col("missed_failures") * F.col("unplanned_cost"))
    return j.select(
        "failure_code", failure_label(F.col("failure_code")).alias("label"),
        F.col("unplanned_cost").alias("unplanned_failure_cost"),
        F.col("preventive_cost").alias("preventive_maintenance_cost"),
        "holdout_failures", "captured_failures", "missed_failures",
        reactive.cast("bigint").alias("reactive_baseline_cost"),
        queue_cost.cast("bigint").alias("risk_queue_cost"),
        (reactive - queue_cost).cast("bigint").alias("savings_vs_reactive"),
        round4(safe_div0(reactive - queue_cost, reactive)).alias("savings_share"),
    )
