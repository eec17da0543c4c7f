"""Row-level features: P2 derived features, P21 what-if shift, P7 informative sensors,
P14 flag unpivot, M11 class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import clip_lower


def add_derived_features(df: DataFrame, torque: str = "torque_nm", rpm: str = "rpm",
                         air: str = "air_temp_k", process: str = "process_temp_k",
                         wear: str = "tool_wear_min") -> DataFrame:
    """mechanical_load = torque*rpm; thermal_stress = (process-air)/air;
    tool_wear_load_ratio = wear / clip_lower(torque, 1e-6) (NULL stays NULL)."""
    return df.withColumns({
        "mechanical_load": F.col(torque) * F.col(rpm),
        "thermal_stress": (F.col(process) - F.col(air)) / F.col(air),
        "tool_wear_load_ratio": F.col(wear) / clip_lower(F.col(torque), C.WEAR_CLIP_FLOOR),
    })


def shift_feature(df: DataFrame, column: str = "tool_wear_min", delta: float = C.SHIFT_MINUTES) -> DataFrame:
    """Add a constant to one raw column, then recompute the derived columns."""
    return add_derived_features(df.withColumn(column, F.col(column) + F.lit(float(delta))))


def unpivot_flags(df: DataFrame, ids: list[str], flag_cols: dict[str, str] | None = None) -> DataFrame:
    """One (code, flag) row per failure mode."""
    flag_cols = flag_cols or {c: c.lower() for c in C.FAILURE_CODES}
    renamed = df.select(*ids, *[F.col(col).alias(code) for code, col in flag_cols.items()])
    return renamed.unpivot(ids, list(flag_cols), "failure_code", "flag")


def informative_columns(df: DataFrame, cols: list[str], threshold: float = C.SENSOR_STD_THRESHOLD) -> list[str]:
    """Columns whose sample std exceeds the threshold (one aggregate action, a list back).

    The schema downstream depends on the data, so this is the one place a small
    result (one number per column) is collected.
    """
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > threshold]


def sensor_std_table(df: DataFrame, cols: list[str], threshold: float = C.SENSOR_STD_THRESHOLD) -> DataFrame:
    """P7/A18/U2 as a table: sensor, sample std, kept flag (long form, lazy)."""
    longf = df.select(*cols).unpivot([], cols, "sensor", "value")
    return (longf.groupBy("sensor").agg(F.stddev_samp("value").alias("std"))
            .withColumn("kept", F.coalesce(F.col("std") > F.lit(threshold), F.lit(False))))


def class_weights(df: DataFrame, label: str = "machine_failure", mode: str = "ratio") -> DataFrame:
    """Weight column. ``ratio``: positives get n_neg / max(n_pos, 1), others 1.0;
    ``balanced``: n / (2 * n_class). Class counts come from a 1-row aggregate."""
    y = F.col(label)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(y).cast("bigint").alias("_np"))
    counts = counts.withColumn("_nn", F.col("_n") - F.col("_np"))
    j = df.crossJoin(F.broadcast(counts))  # one row: proven bound
    if mode == "balanced":
        w = F.when(y == 1, F.col("_n") / (2.0 * F.col("_np"))).otherwise(F.col("_n") / (2.0 * F.col("_nn")))
    else:
        w = F.when(y == 1, F.col("_nn") / F.greatest(F.col("_np"), F.lit(1)).cast("double")).otherwise(F.lit(1.0))
    return j.withColumn("weight", w.cast("double")).drop("_n", "_np", "_nn")
