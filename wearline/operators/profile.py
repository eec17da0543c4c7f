"""A1 dataset profile, A2 category shares, A3 distinct units, J7 full vs holdout counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.functions import constants as C


def dataset_profile(df: DataFrame, label: str = "machine_failure",
                    flag_cols: dict[str, str] | None = None) -> DataFrame:
    """A1: one pass; row count, target counts and mode totals (one row)."""
    flag_cols = flag_cols or {c: c.lower() for c in C.FAILURE_CODES}
    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("no_failure"),
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("failure"),
        F.round(F.avg(y.cast("double")), 4).alias("failure_rate"),
        *[F.sum(F.col(col)).cast("bigint").alias(f"{code.lower()}_total") for code, col in flag_cols.items()],
    )


def category_shares(df: DataFrame, category: str = "machine_type") -> DataFrame:
    """A1/A2: count per category and its share in percent (2 places).

    The window runs over the grouped rows (one per category), not over the data.
    """
    g = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return g.select(category, "n", F.round(F.col("n") * 100.0 / total, 2).alias("share_pct"))


def distinct_units(df: DataFrame, unit: str = "unit_number", by: list[str] | tuple = ()) -> DataFrame:
    """A3: number of distinct units (per set)."""
    return df.groupBy(*by).agg(F.countDistinct(unit).alias("n_units"))


def full_vs_subset_counts(full: DataFrame, subset: DataFrame, category: str) -> DataFrame:
    """Counts per category in the full data and in the subset, 0 when absent."""
    a = full.groupBy(category).agg(F.count(F.lit(1)).alias("full_count"))
    b = subset.groupBy(category).agg(F.count(F.lit(1)).alias("subset_count"))
    return (a.join(b, category, "left")
            .select(category, "full_count", F.coalesce("subset_count", F.lit(0)).cast("bigint").alias("subset_count")))
