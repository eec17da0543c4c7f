"""File sources and sinks: S1 CSV snapshot, S2 whitespace text, S3 positional truth,
S4 JSON documents, S5 artifact bundles, S6 result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from wearline.session import path_exists

# Snapshot CSV header -> our column names (header text as it appears in the file)
SNAPSHOT_COLUMNS = {
    "UDI": ("udi", LongType()),
    "Product ID": ("product_id", StringType()),
    "Type": ("machine_type", StringType()),
    "Air temperature [K]": ("air_temp_k", DoubleType()),
    "Process temperature [K]": ("process_temp_k", DoubleType()),
    "Rotational speed [rpm]": ("rpm", DoubleType()),
    "Torque [Nm]": ("torque_nm", DoubleType()),
    "Tool wear [min]": ("tool_wear_min", DoubleType()),
    "Machine failure": ("machine_failure", IntegerType()),
    "TWF": ("twf", IntegerType()),
    "HDF": ("hdf", IntegerType()),
    "PWF": ("pwf", IntegerType()),
    "OSF": ("osf", IntegerType()),
    "RNF": ("rnf", IntegerType()),
}

CYCLE_COLUMNS = (["unit_number", "time_cycles"] + [f"setting_{i}" for i in range(1, 4)]
                 + [f"sensor_{i}" for i in range(1, 22)])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL on double columns (Spark sorts NaN above all numbers and lets it
    poison avg/max; the reference drops or imputes missing values)."""
    return df.select(*[F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if t == "double" else F.col(c) for c, t in df.dtypes])


def read_snapshot_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; declared types; names without blanks and brackets."""
    schema = StructType([StructField(h, t) for h, (_, t) in SNAPSHOT_COLUMNS.items()])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return nan_to_null(df.toDF(*[SNAPSHOT_COLUMNS[c][0] for c in df.columns]))


def read_cycles_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated, no header, 26 fixed columns; trailing extra columns cut."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    cols = []
    for i, name in enumerate(CYCLE_COLUMNS):
        t = "int" if i < 2 else "double"
        cols.append(F.try_element_at(parts, F.lit(i + 1)).cast(t).alias(name))
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(*cols)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """S3: one number per line; line n (1-based, blank lines not counted) belongs to the n-th unit in unit order.

    Files are read in byte ranges, as Spark cuts them; lines are numbered within their range, and a range begins after the
    lines of all ranges before it (a row a range). Files follow each other by the first number in their names, as Spark numbers
    the parts of a sorted frame (part-99999 comes before part-100000), then by name."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                                         F.monotonically_increasing_id().alias("_at")).where(F.length(F.trim("value")) > 0)
    ranges = lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    number = F.try_to_number(F.nullif(F.regexp_extract("_f", "([0-9]+)", 1), F.lit("")), F.lit("9" * 38))
    before = F.sum("_n").over(Window.orderBy(F.regexp_extract("_f", "^[^0-9]*", 0), number.asc_nulls_first(), "_f", "_b").rowsBetween(Window.unboundedPreceding, -1))  # over ranges
    offsets = ranges.select(F.col("_f").alias("_g"), F.col("_b").alias("_h"), F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_at"))  # one byte range
    return lines.withColumn("_i", inside).join(offsets, (F.col("_f") == F.col("_g")) & (F.col("_b") == F.col("_h"))).select(
        (F.col("_o") + F.col("_i")).cast("long").alias("unit_ordinal"), F.trim("value").cast("double").cast("int").alias("rul"))


def read_json_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON documents (an array of objects or one nested object) with a declared schema."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def load_bundle(spark: SparkSession, paths: dict[str, str], schemas: dict[str, StructType],
                required: list[str]) -> dict[str, DataFrame]:
    """Named artifacts; a missing required one is an error, a missing optional one is
    an empty frame with its schema."""
    out = {}
    for name, schema in schemas.items():
        p = paths.get(name)
        if p and path_exists(spark, p):
            out[name] = read_json_documents(spark, p, schema)
        elif name in required:
            raise FileNotFoundError(f"required artifact {name!r} missing at {p}")
        else:
            out[name] = spark.createDataFrame([], schema)
    return out


def write_result(df: DataFrame, path: str, fmt: str = "json", **options) -> None:
    """Result sink; Spark creates the parent directories."""
    df.write.mode("overwrite").format(fmt).options(**options).save(path)
