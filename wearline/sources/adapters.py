"""Adapters: the maintenance data model expressed as views over the driver's tables.

The rules are ours and deterministic, so the same view can be written in DuckDB SQL
(see ``wearline.plans.oracle``) and both engines agree to the bit:

readings  (one row per machine snapshot) from ``events``
cycles    (run-to-failure history, one row per unit and cycle) from ``events``
telemetry (live feed: production, scrap, downtime, tool changes) from ``events``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.operators.rank import global_row_number
from wearline.sources.tables import table

NUMERIC_FEATURES = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min"]
DERIVED_FEATURES = ["mechanical_load", "thermal_stress", "tool_wear_load_ratio"]
CATEGORICAL_FEATURES = ["machine_type"]
MODEL_FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES
MODEL_FEATURES_ENHANCED = MODEL_FEATURES + DERIVED_FEATURES
FLAG_COLUMNS = {code: code.lower() for code in C.FAILURE_CODES}

SENSOR_COLUMNS = ["sensor_1", "sensor_2", "sensor_3", "sensor_4"]


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def readings_from_events(events: DataFrame) -> DataFrame:
    """Snapshot table: product_id, machine_type, 5 raw features, 5 flags, failure, risk."""
    k = _k()
    air = F.lit(295.0) + (k % 10)
    process = air + F.lit(8.0) + (F.hour("ts") % 5)
    rpm = F.lit(1200.0) + F.lit(15.0) * k
    torque = F.col("value")
    wear = ((F.col("event_id") * 7) % 250).cast("double")
    df = events.select(
        F.col("event_id").alias("product_id"),
        F.col("event_type").alias("machine_type"),
        F.col("ts"),
        air.alias("air_temp_k"),
        process.alias("process_temp_k"),
        rpm.alias("rpm"),
        torque.alias("torque_nm"),
        wear.alias("tool_wear_min"),
    )
    df = df.withColumns({
        "twf": (F.col("tool_wear_min") >= 240).cast("int"),
        "hdf": (((F.col("process_temp_k") - F.col("air_temp_k")) < 9) & (F.col("rpm") < 1380)).cast("int"),
        "pwf": ((F.col("torque_nm") * F.col("rpm")) > 300000).cast("int"),
        "osf": ((F.col("torque_nm") * F.col("tool_wear_min")) > 20000).cast("int"),
        "rnf": ((F.col("product_id") % 499) == 0).cast("int"),
    })
    x = F.col("torque_nm") * F.col("tool_wear_min") / 11000.0
    return df.withColumns({
        "machine_failure": F.greatest(*[F.col(c) for c in FLAG_COLUMNS.values()]),
        "risk": x / (1.0 + x),
    })


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(table(spark, sf_dir, "events"))


def cycles_from_events(events: DataFrame) -> DataFrame:
    """Run-to-failure table: unit = user_id, cycle = order of (ts, event_id) in the unit.

    Cycles are numbered by ``rank.global_row_number``, so a unit that holds a third of all events is
    spread over many buckets; inputs of one bucket take a plain window on the unit, whose
    exchange every later per-unit window reuses.
    """
    base = events.select(F.col("user_id").alias("unit_number"), "ts", "event_id", "value", "props")
    base = global_row_number(base, "ts", tie="event_id", by=["unit_number"], out="time_cycles")
    return base.select(
        "unit_number",
        F.col("time_cycles").cast("int").alias("time_cycles"),
        F.col("value").alias("sensor_1"),
        _k().cast("double").alias("sensor_2"),
        F.hour("ts").cast("double").alias("sensor_3"),
        F.lit(5.0).alias("sensor_4"),
    )


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles_from_events(table(spark, sf_dir, "events"))


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Live feed: one tick per event; machine = user_id."""
    k = _k()
    is_error = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("tick_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("machine_id"),
        F.col("event_type").alias("machine_type"),
        (F.lit(295.0) + (k % 10)).alias("air_temp_k"),
        (F.lit(303.0) + (k % 10) + (F.hour("ts") % 5)).alias("process_temp_k"),
        (F.lit(1200.0) + F.lit(15.0) * k).alias("rpm"),
        F.col("value").alias("torque_nm"),
        (k % 4).cast("int").alias("production_inc"),
        is_error.cast("int").alias("scrap_inc"),
        F.when(is_error, F.col("value") / 50.0).otherwise(F.lit(0.0)).alias("downtime_s"),
        (F.lit(0.5) + (k % 21) / 10.0).alias("wear_inc"),
        (F.col("event_type") == "signup").alias("tool_change"),
        (F.lit(60.0) + (k % 36)).alias("spindle_load"),
        (F.lit(115.0) + (k % 34)).alias("hydraulic_pressure"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(table(spark, sf_dir, "events"))
