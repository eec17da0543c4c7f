"""S8 telemetry feed schema and file-source reader; S9 sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType, TimestampType)

TELEMETRY_SCHEMA = StructType([
    StructField("tick_id", LongType()),
    StructField("ts", TimestampType()),
    StructField("machine_id", LongType()),
    StructField("machine_type", StringType()),
    StructField("air_temp_k", DoubleType()),
    StructField("process_temp_k", DoubleType()),
    StructField("rpm", DoubleType()),
    StructField("torque_nm", DoubleType()),
    StructField("production_inc", IntegerType()),
    StructField("scrap_inc", IntegerType()),
    StructField("downtime_s", DoubleType()),
    StructField("wear_inc", DoubleType()),
    StructField("tool_change", BooleanType()),
    StructField("spindle_load", DoubleType()),
    StructField("hydraulic_pressure", DoubleType()),
])


def read_telemetry_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """``readStream`` of parquet telemetry files with the fixed schema (no inference)."""
    r = spark.readStream.schema(TELEMETRY_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def write_stream(df: DataFrame, fmt: str, path_or_name: str, checkpoint: str, mode: str = "append",
                 available_now: bool = True):
    """Start a query into parquet/json files or the memory sink (tests)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    if fmt == "memory":
        return w.format("memory").queryName(path_or_name).start()
    return w.format(fmt).option("path", path_or_name).start()
