"""Streaming operators. Batch twins live in ``wearline.operators.telemetry``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import heuristic_rul, risk_band
from wearline.operators.drift import bin_of, reference_histogram
from wearline.operators.features import add_derived_features
from wearline.operators.telemetry import oee_columns
from wearline.session import stage
from wearline.streaming.state import keep_state_on_disk, live_board, production_stats, recent_readings, wear_tracking

__all__ = ["current_drift", "frozen_histogram", "keep_state_on_disk", "live_board", "live_scoring", "newest_version", "production_stats", "psi_of_cells",
           "publish_model", "recent_readings", "start_drift_monitor", "start_scoring", "wear_tracking", "windowed_cells", "windowed_oee"]

# --- R1 live scoring (stateless) ---------------------------------------------------------


def live_scoring(stream: DataFrame, model=None, wear_col: str = "tool_wear_min") -> DataFrame:
    """Derive features, score, heuristic RUL and risk band for every tick.

    With a fitted ``PipelineModel`` the model scores (it transforms streams as well);
    without one the closed-form wear x torque risk is used."""
    d = add_derived_features(stream)
    if model is not None:
        from wearline.ml.estimators import positive_probability
        d = positive_probability(model.transform(d), "risk")
    else:
        x = F.col("torque_nm") * F.col(wear_col) / 11000.0
        d = d.withColumn("risk", x / (1.0 + x))
    return d.withColumns({"rul_hours": heuristic_rul("risk"), "risk_band": risk_band("risk")})


# --- R2 OEE per machine and tumbling window ---------------------------------------------------


def windowed_oee(stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """R2: OEE per (machine, tumbling window); rows later than the watermark are dropped.
    In append mode a window is emitted once, when the watermark passes its end."""
    g = (stream.withWatermark("ts", watermark)
         .groupBy("machine_id", F.window("ts", window).alias("w"))
         .agg(F.sum("production_inc").cast("bigint").alias("production"),
              F.sum("scrap_inc").cast("bigint").alias("scrap"),
              F.sum("downtime_s").alias("downtime_s")))
    elapsed = F.col("w.end").cast("long") - F.col("w.start").cast("long")
    return g.select("machine_id", F.col("w.start").alias("window_start"), "production", "scrap",
                    F.round("downtime_s", 4).alias("downtime_s"),
                    *[v.alias(k) for k, v in oee_columns("production", "scrap", "downtime_s", elapsed).items()])


# --- R1 with a saved, replaceable model ------------------------------------------------------------


def publish_model(model, folder: str, version: int) -> None:
    """Save a fitted pipeline as ``version`` of the folder; it counts from the moment its mark is written."""
    from wearline.ml import estimators

    estimators.save(model, f"{folder}/version={version}")
    spark = SparkSession.active()
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ready/{version}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()


def newest_version(spark: SparkSession, folder: str) -> int:
    """The highest published version (a listing of the folder's marks, one a version)."""
    ready = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ready")
    fs = ready.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [int(f.getPath().getName()) for f in fs.listStatus(ready)] if fs.exists(ready) else []
    if not versions:
        raise FileNotFoundError(f"no published model in {folder}")
    return max(versions)


def start_scoring(stream: DataFrame, models: str, out_path: str, checkpoint: str, columns: list[str], wear_col: str = "tool_wear_min",
                  available_now: bool = True):
    """Every micro-batch is scored by the version that is newest when it begins, and keeps it to its end; a version
    published meanwhile serves the next one. Rows carry ``model_version``; a repeated batch replaces its own rows."""
    from wearline.ml import estimators

    held: dict = {}

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        version = newest_version(batch.sparkSession, models)
        if held.get("version") != version:
            held.update(version=version, model=estimators.load(f"{models}/version={version}"))
        scored = live_scoring(batch, held["model"], wear_col).withColumn("model_version", F.lit(version))
        scored.select(*columns, "model_version").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(per_batch)
    return (w.trigger(availableNow=True) if available_now else w).start()


# --- R5 windowed drift against a frozen reference ------------------------------------------------


def frozen_histogram(reference: DataFrame, numeric: list[str], categorical: list[str], n_buckets: int | None = None) -> tuple[dict[str, list[float]], DataFrame]:
    """The reference's interior breakpoints per numeric feature, and its histogram ``(feature, bin, ref_share)``: all bins of
    numeric features (empty ones share 0), every category of categorical ones (shares of all rows, NULL included)."""
    edges, shares = reference_histogram(reference, numeric, n_buckets=n_buckets)
    spark = reference.sparkSession
    rows = [(f, str(i), float(v)) for f, vs in shares.items() for i, v in enumerate(vs)]  # features x bins
    table = spark.createDataFrame(rows, "feature string, bin string, ref_share double")
    if categorical:
        wide = reference.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], categorical, "feature", "bin")
        counts = wide.groupBy("feature", "bin").agg(F.count("*").alias("n"))
        total = F.sum("n").over(Window.partitionBy("feature"))  # over the categories
        counts = counts.withColumn("ref_share", F.col("n") / total.cast("double")).where("bin is not null")
        table = table.unionByName(counts.select("feature", "bin", "ref_share"))
    return edges, stage(table, "frozen-histogram")


def windowed_cells(stream: DataFrame, edges: dict[str, list[float]], categorical: list[str], window: str = "1 day",
                   watermark: str = "1 hour") -> DataFrame:
    """R5 step 1: ``(w, feature, bin, n)``, one row per window, feature and bin or category. Values of numeric features without
    a bin (NULL, NaN) are not counted, NULL categories are, as the batch form does."""
    src = stream.withWatermark("ts", watermark) if stream.isStreaming else stream  # batch twin: no watermark
    cells = [F.struct(F.lit(f).alias("feature"), bin_of(F.col(f).cast("double"), interior).cast("string").alias("bin"), F.lit(True).alias("numeric")) for f, interior in edges.items()]
    cells += [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("bin"), F.lit(False).alias("numeric")) for c in categorical]
    long = src.select("ts", F.inline(F.array(*cells))).where("bin is not null or not numeric")
    return long.groupBy(F.window("ts", window).alias("w"), "feature", "bin").agg(F.count("*").alias("n"))


def psi_of_cells(cells: DataFrame, frozen: DataFrame) -> DataFrame:
    """R5 step 2 over the cells of whole windows: PSI per (window, feature) against the frozen shares; bins and categories that
    one side lacks count with epsilon."""
    total = cells.groupBy("w", "feature").agg(F.sum("n").alias("total"))
    grid = total.join(frozen, "feature").select("w", "feature", "bin", "total", "ref_share")
    known = cells.where("bin is not null").select("w", "feature", "bin", "n")
    new = known.join(frozen.select("feature", "bin"), ["feature", "bin"], "left_anti").join(total, ["w", "feature"])  # categories the reference has not
    both = grid.join(known, ["w", "feature", "bin"], "left").select("w", "feature", "total", "ref_share", "n").unionByName(
        new.select("w", "feature", "total", F.lit(0.0).alias("ref_share"), "n"))
    cur = F.greatest(F.coalesce("n", F.lit(0)) / F.col("total").cast("double"), F.lit(C.PSI_EPS))
    ref = F.greatest("ref_share", F.lit(C.PSI_EPS))
    return both.groupBy(F.col("w.start").alias("window_start"), "feature").agg(F.sum((cur - ref) * F.log(cur / ref)).alias("psi"))


def start_drift_monitor(stream: DataFrame, edges: dict[str, list[float]], frozen: DataFrame, categorical: list[str], out_path: str, checkpoint: str,
                        window: str = "1 day", watermark: str = "1 hour", available_now: bool = True):
    """R5 end to end: windowed counts as a stateful stream (update mode: a batch gives out the cells it changed), joined to the
    frozen histogram as the static side, written under the batch id (a repeated batch replaces its own rows).
    ``current_drift`` reads the sink."""
    keep_state_on_disk(stream.sparkSession)
    counts = windowed_cells(stream, edges, categorical, window, watermark).join(frozen, ["feature", "bin"], "left")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(per_batch)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current_drift(sink: DataFrame, frozen: DataFrame) -> DataFrame:
    """PSI per (window, feature) of all that a monitor has written: each cell's last count, against the frozen shares."""
    cells = sink.groupBy("w", "feature", "bin").agg(F.max_by("n", "batch_id").alias("n"))
    return psi_of_cells(cells, frozen)
