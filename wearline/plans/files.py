"""File-source queries: data derived from the driver's tables is written with Spark in the
reference's file formats (under the session's shared checkpoint folder) and read back with
our readers — S1 snapshot CSV, S2 whitespace cycles text, S3 positional truth (J5), S6 sink,
S10 contract report."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import after_first_separator, percent_label, thousands_label
from wearline.operators import economics, queue, rul
from wearline.plans.registry import register
from wearline.plans.rul import EVAL_SQL, KEEP
from wearline.plans.snapshot import review_queue_sql
from wearline.plans.views import CYCLES, RANKED, READINGS, with_
from wearline.session import ensure_checkpoint_dir
from wearline.sources import files
from wearline.sources.adapters import cycles, readings
from wearline.sources.contract import contract_report


def _scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"wearline-{name}-{uuid.uuid4().hex}")


@register("csv_snapshot_scan", ids="S1 S6 P20 P1", oracle=with_(READINGS) + """
SELECT CAST(product_id AS VARCHAR) AS product_id, machine_type, air_temp_k, torque_nm, tool_wear_min,
       machine_failure, twf, rnf
FROM readings""")
def q_csv_snapshot_scan(spark, sf_dir):
    r = readings(spark, sf_dir)
    header = {v[0]: k for k, v in files.SNAPSHOT_COLUMNS.items()}  # our name -> file header
    out = r.select(F.col("product_id").alias("udi"), F.col("product_id").cast("string").alias("product_id"),
                   "machine_type", "air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min",
                   "machine_failure", "twf", "hdf", "pwf", "osf", "rnf")
    path = _scratch(spark, "snapshot-csv")
    files.write_result(out.toDF(*[header[c] for c in out.columns]), path, fmt="csv", header=True)  # S6
    back = files.read_snapshot_csv(spark, path)
    return back.select("product_id", "machine_type", "air_temp_k", "torque_nm", "tool_wear_min",
                       "machine_failure", "twf", "rnf")


@register("text_cycles_scan", ids="S2 T6", oracle=with_(CYCLES) + """
SELECT unit_number, time_cycles, sensor_1, sensor_2, sensor_3, sensor_4 FROM cycles""")
def q_text_cycles_scan(spark, sf_dir):
    c = cycles(spark, sf_dir)
    vals = [F.col("unit_number").cast("string"), F.col("time_cycles").cast("string")]
    vals += [F.lit("0.0")] * 3  # settings
    vals += [F.col(f"sensor_{i}").cast("string") for i in range(1, 5)] + [F.lit("0.0")] * 17
    path = _scratch(spark, "cycles-txt")
    c.select(F.concat_ws(" ", *vals, F.lit("")).alias("value")).write.mode("overwrite").text(path)
    back = files.read_cycles_text(spark, path)
    return back.select(F.col("unit_number").cast("bigint").alias("unit_number"), "time_cycles",
                       "sensor_1", "sensor_2", "sensor_3", "sensor_4")


@register("truth_join", ids="S3 J5 J6 W4", oracle=with_(CYCLES, EVAL_SQL) + """
SELECT unit_number, time_cycles, CAST(true_rul AS INTEGER) AS rul FROM last""")
def q_truth_join(spark, sf_dir):
    test = rul.truncate_units(cycles(spark, sf_dir), KEEP)
    last = rul.last_cycle_rows(test)
    path = _scratch(spark, "truth-txt")
    # the truth is positional: one line per unit in unit order, part files in range order
    last.orderBy("unit_number").select(F.col("true_rul").cast("string")).write.text(path)
    truth = files.read_truth(spark, path)
    j = rul.join_truth_by_position(last.select("unit_number", "time_cycles"), truth)
    return j.select("unit_number", "time_cycles", "rul")


@register("readings_contract", ids="S10 P6", oracle=with_(READINGS) + """
SELECT count(*) AS rows,
       CAST(sum(CASE WHEN risk IS NULL OR risk < 0 OR risk > 1 THEN 1 ELSE 0 END) AS BIGINT) AS risk_violations,
       CAST(sum(CASE WHEN machine_failure IS NULL OR machine_failure < 0 OR machine_failure > 1 THEN 1 ELSE 0 END) AS BIGINT)
           AS machine_failure_violations,
       CAST(sum(CASE WHEN tool_wear_min IS NULL OR tool_wear_min < 0 OR tool_wear_min > 250 THEN 1 ELSE 0 END) AS BIGINT)
           AS tool_wear_min_violations,
       count(*) >= 1 AND sum(CASE WHEN risk IS NULL OR risk < 0 OR risk > 1 THEN 1 ELSE 0 END) = 0
           AND sum(CASE WHEN machine_failure IS NULL OR machine_failure < 0 OR machine_failure > 1 THEN 1 ELSE 0 END) = 0
           AND sum(CASE WHEN tool_wear_min IS NULL OR tool_wear_min < 0 OR tool_wear_min > 250 THEN 1 ELSE 0 END) = 0 AS ok
FROM readings""")
def q_readings_contract(spark, sf_dir):
    return contract_report(readings(spark, sf_dir),
                           {"risk": (0.0, 1.0), "machine_failure": (0, 1), "tool_wear_min": (0.0, 250.0)}, min_rows=1)


@register("cost_display", ids="F12 F11 A21", oracle=with_(READINGS, RANKED) + f""",
{'''budgets AS (
    SELECT b.review_fraction, greatest(1, CAST(ceil(t.total_rows * b.review_fraction) AS BIGINT)) AS reviewed_assets,
           t.total_rows, t.total_failures
    FROM (VALUES (0.1::DOUBLE)) b(review_fraction), qtot t
)'''},
cap AS (
    SELECT b.*, CAST(sum(r.machine_failure) AS BIGINT) AS captured_failures
    FROM budgets b JOIN ranked r ON r.queue_rank <= b.reviewed_assets GROUP BY ALL
),
c AS (
    SELECT total_failures * {C.UNPLANNED_FAILURE_COST} AS reactive,
           reviewed_assets * {C.REVIEW_COST_PER_ASSET} + captured_failures * {C.PREVENTIVE_MAINTENANCE_COST}
             + (total_failures - captured_failures) * {C.UNPLANNED_FAILURE_COST} AS queue_cost
    FROM cap
)
SELECT 'scenario__risk_queue' AS metric_key, 'risk_queue' AS metric,
       format('{{:,}}', CAST(reactive AS BIGINT)) AS reactive_label,
       format('{{:,}}', CAST(reactive - queue_cost AS BIGINT)) AS savings_label,
       format('{{:.1f}}', round((reactive - queue_cost) / reactive, 4) * 100.0) || '%' AS savings_share_label
FROM c""")
def q_cost_display(spark, sf_dir):
    r = readings(spark, sf_dir)
    q = queue.queue_counts_by_selection(r, [C.PRIMARY_REVIEW_FRACTION])
    cs = economics.cost_scenarios(q)
    return cs.select(F.lit("scenario__risk_queue").alias("metric_key"),
                     after_first_separator(F.lit("scenario__risk_queue")).alias("metric"),
                     thousands_label("reactive_baseline_cost").alias("reactive_label"),
                     thousands_label("savings_vs_reactive").alias("savings_label"),
                     percent_label("savings_vs_reactive_share").alias("savings_share_label"))


@register("artifact_bundle", ids="S4 S5 S6 J2 F9", oracle=with_(READINGS, RANKED) + ",\n" + review_queue_sql(C.REVIEW_FRACTIONS) +
    "\nSELECT review_fraction, reviewed_assets, captured_failures, yield_lift_vs_random FROM rq")
def q_artifact_bundle(spark, sf_dir):
    """The review-queue document is written as JSON (S6), loaded as a bundle with a missing
    optional artifact (S5) through the schema-declared JSON reader (S4) and unnested (J2)."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
    rq = queue.review_queue(readings(spark, sf_dir))
    doc = rq.agg(F.sort_array(F.collect_list(F.struct(*rq.columns))).alias("review_budgets"))  # 3 entries
    path = _scratch(spark, "review-queue-json")
    files.write_result(doc.coalesce(1), path, fmt="json")
    schema = StructType([StructField("review_budgets", ArrayType(StructType(
        [StructField("review_fraction", DoubleType()), StructField("reviewed_assets", LongType()),
         StructField("captured_failures", LongType()), StructField("failure_capture_rate", DoubleType()),
         StructField("review_yield", DoubleType()), StructField("random_review_yield", DoubleType()),
         StructField("yield_lift_vs_random", DoubleType())])))])
    bundle = files.load_bundle(spark, {"review_queue": path, "calibration": path + "-missing"},
                               {"review_queue": schema, "calibration": schema}, required=["review_queue"])
    return bundle["review_queue"].select(F.inline("review_budgets")).select(
        "review_fraction", "reviewed_assets", "captured_failures", "yield_lift_vs_random")
