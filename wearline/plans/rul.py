"""Run-to-failure queries over the ``cycles`` view (unit = machine, cycle = tick order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import round4
from wearline.ml.split import group_folds
from wearline.operators import features, metrics, profile, rul
from wearline.plans.registry import register
from wearline.plans.views import CYCLES, with_
from wearline.sources.adapters import SENSOR_COLUMNS, cycles

KEEP = 0.8
SENSORS_SQL = ["sensor_1", "sensor_2", "sensor_3"]  # sensor_4 is constant and dropped by P7


@register("rolling_features", ids="W2 T6 P7 P1", oracle=with_(CYCLES) + "SELECT unit_number, time_cycles, " + ", ".join(
    f"round(avg({s}) OVER w, 4) AS {s}_roll_mean, round(coalesce(stddev_samp({s}) OVER w, 0.0), 4) AS {s}_roll_std"
    for s in SENSORS_SQL) + """
FROM cycles
WINDOW w AS (PARTITION BY unit_number ORDER BY time_cycles ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def q_rolling_features(spark, sf_dir):
    cyc = cycles(spark, sf_dir)
    sensors = features.informative_columns(cyc, SENSOR_COLUMNS)
    r = rul.add_rolling_features(cyc, sensors)
    out = ["unit_number", "time_cycles"]
    for s in sensors:
        out += [round4(f"{s}_roll_mean").alias(f"{s}_roll_mean"), round4(f"{s}_roll_std").alias(f"{s}_roll_std")]
    return r.select(*out)


@register("train_rul", ids="P5 W3 F4", oracle=with_(CYCLES) + f"""
SELECT unit_number, time_cycles,
       CAST(CASE WHEN max(time_cycles) OVER (PARTITION BY unit_number) - time_cycles > {C.RUL_CAP}
                 THEN {C.RUL_CAP} ELSE max(time_cycles) OVER (PARTITION BY unit_number) - time_cycles END AS INTEGER) AS rul
FROM cycles""")
def q_train_rul(spark, sf_dir):
    return rul.add_train_rul(cycles(spark, sf_dir)).select("unit_number", "time_cycles", "rul")


@register("last_cycle", ids="W4", oracle=with_(CYCLES) + """
SELECT unit_number, time_cycles, sensor_1, sensor_2, sensor_3 FROM cycles
QUALIFY row_number() OVER (PARTITION BY unit_number ORDER BY time_cycles DESC) = 1""")
def q_last_cycle(spark, sf_dir):
    return rul.last_cycle_rows(cycles(spark, sf_dir)).select("unit_number", "time_cycles", "sensor_1",
                                                              "sensor_2", "sensor_3")


@register("informative_sensors", ids="P7 A18 U2", oracle=with_(CYCLES) + f"""
SELECT sensor, round(std, 6) AS std, coalesce(std > {C.SENSOR_STD_THRESHOLD!r}::DOUBLE, false) AS kept
FROM (SELECT sensor, stddev_samp(value) AS std
      FROM (UNPIVOT (SELECT sensor_1, sensor_2, sensor_3, sensor_4 FROM cycles)
            ON sensor_1, sensor_2, sensor_3, sensor_4 INTO NAME sensor VALUE value)
      GROUP BY sensor)""")
def q_informative_sensors(spark, sf_dir):
    t = features.sensor_std_table(cycles(spark, sf_dir), SENSOR_COLUMNS)
    return t.select("sensor", F.round("std", 6).alias("std"), "kept")


EVAL_SQL = f"""lives AS (SELECT unit_number, max(time_cycles) AS life FROM cycles GROUP BY unit_number),
test AS (
    SELECT c.*, l.life - greatest(1, CAST(floor(l.life * {KEEP!r}::DOUBLE) AS INTEGER)) AS true_rul
    FROM cycles c JOIN lives l USING (unit_number)
    WHERE c.time_cycles <= greatest(1, CAST(floor(l.life * {KEEP!r}::DOUBLE) AS INTEGER))
),
last AS (SELECT * FROM test QUALIFY row_number() OVER (PARTITION BY unit_number ORDER BY time_cycles DESC) = 1),
med AS (SELECT quantile_cont(life, 0.5) AS median FROM lives),
pred AS (
    SELECT last.*, CASE WHEN median - time_cycles < 0 THEN 0.0::DOUBLE
                        WHEN median - time_cycles > {C.RUL_CAP} THEN {float(C.RUL_CAP)!r}::DOUBLE
                        ELSE median - time_cycles END AS predicted_rul
    FROM last, med
),
trainrul AS (
    SELECT CASE WHEN max(time_cycles) OVER (PARTITION BY unit_number) - time_cycles > {C.RUL_CAP} THEN {C.RUL_CAP}
                ELSE max(time_cycles) OVER (PARTITION BY unit_number) - time_cycles END AS rul
    FROM cycles
),
bmed AS (SELECT quantile_cont(rul, 0.5) AS baseline FROM trainrul),
scored AS (
    SELECT true_rul, predicted_rul, baseline,
           predicted_rul - true_rul AS d, baseline - true_rul AS bd
    FROM pred, bmed
),
evald AS (
    SELECT count(*) AS n_units, any_value(baseline) AS baseline_value,
           sqrt(avg(d * d)) AS model_rmse,
           sum(CASE WHEN d < 0 THEN exp(-d / 13.0::DOUBLE) - 1.0 ELSE exp(d / 10.0::DOUBLE) - 1.0 END) AS model_phm08,
           sqrt(avg(bd * bd)) AS baseline_rmse,
           sum(CASE WHEN bd < 0 THEN exp(-bd / 13.0::DOUBLE) - 1.0 ELSE exp(bd / 10.0::DOUBLE) - 1.0 END) AS baseline_phm08
    FROM scored
)"""


def _eval_frames(spark, sf_dir):
    cyc = cycles(spark, sf_dir)
    lives = rul.unit_lives(cyc)
    test = rul.truncate_units(cyc, KEEP)
    last = rul.last_cycle_rows(test)
    pred = rul.life_predictor(last, lives)
    base = rul.median_value(rul.add_train_rul(cyc), "rul").select(F.col("median").alias("baseline"))
    scored = pred.crossJoin(F.broadcast(base))  # one row: proven bound
    return cyc, test, pred, scored


@register("rul_eval", ids="J6 A9 A10 A11 A12 M18 W4 F6", oracle=with_(CYCLES, EVAL_SQL) + """
SELECT n_units, round(model_rmse, 4) AS model_rmse, round(model_phm08, 4) AS model_phm08,
       round(baseline_rmse, 4) AS baseline_rmse, round(baseline_phm08, 4) AS baseline_phm08,
       round(CASE WHEN baseline_rmse <> 0 THEN (baseline_rmse - model_rmse) / baseline_rmse * 100.0 ELSE 0.0 END, 4) AS rmse_lift_pct,
       round(CASE WHEN baseline_phm08 <> 0 THEN (baseline_phm08 - model_phm08) / baseline_phm08 * 100.0 ELSE 0.0 END, 4) AS phm08_lift_pct
FROM evald""")
def q_rul_eval(spark, sf_dir):
    _, _, _, scored = _eval_frames(spark, sf_dir)
    m = metrics.regression_scores(scored, "true_rul", "predicted_rul")
    b = metrics.regression_scores(scored, "true_rul", "baseline").select(
        F.col("rmse").alias("baseline_rmse"), F.col("phm08_score").alias("baseline_phm08"))
    j = m.crossJoin(F.broadcast(b))  # one row each: proven bound
    return j.select("n_units", round4("rmse").alias("model_rmse"), round4("phm08_score").alias("model_phm08"),
                    round4("baseline_rmse").alias("baseline_rmse"), round4("baseline_phm08").alias("baseline_phm08"),
                    round4(metrics.lift_vs_baseline(F.col("rmse"), F.col("baseline_rmse"))).alias("rmse_lift_pct"),
                    round4(metrics.lift_vs_baseline(F.col("phm08_score"), F.col("baseline_phm08")))
                    .alias("phm08_lift_pct"))


@register("median_baseline", ids="A11 A9 A10", oracle=with_(CYCLES, EVAL_SQL) + """
SELECT n_units, round(baseline_value, 4) AS baseline_rul, round(baseline_rmse, 4) AS baseline_rmse,
       round(baseline_phm08, 4) AS baseline_phm08 FROM evald""")
def q_median_baseline(spark, sf_dir):
    _, _, _, scored = _eval_frames(spark, sf_dir)
    b = metrics.regression_scores(scored, "true_rul", "baseline")
    v = scored.agg(F.first("baseline").alias("baseline_rul"))
    return b.crossJoin(F.broadcast(v)).select(  # one row each
        "n_units", round4("baseline_rul").alias("baseline_rul"),
        round4("rmse").alias("baseline_rmse"), round4("phm08_score").alias("baseline_phm08"))


@register("trajectories", ids="M17 P17 F14 J3 J6", oracle=with_(CYCLES, EVAL_SQL) + f"""
, units AS (SELECT DISTINCT unit_number FROM test ORDER BY unit_number LIMIT 3),
final AS (SELECT unit_number, time_cycles AS final_cycle, true_rul FROM last),
rows_ AS (
    SELECT t.unit_number, t.time_cycles, m.median
    FROM test t JOIN units u USING (unit_number), med m
)
SELECT r.unit_number, r.time_cycles,
       round(CASE WHEN median - r.time_cycles < 0 THEN 0.0::DOUBLE
                  WHEN median - r.time_cycles > {C.RUL_CAP} THEN {float(C.RUL_CAP)!r}::DOUBLE
                  ELSE median - r.time_cycles END, 4) AS predicted_rul,
       CAST(f.final_cycle - r.time_cycles + f.true_rul AS DOUBLE) AS true_rul_extrapolated
FROM rows_ r JOIN final f USING (unit_number)""")
def q_trajectories(spark, sf_dir):
    cyc = cycles(spark, sf_dir)
    test = rul.truncate_units(cyc, KEEP)
    # sample units: the three lowest unit numbers (the selection is the feature)
    units = test.select("unit_number").distinct().orderBy("unit_number").limit(3)
    final = rul.last_cycle_rows(test).select("unit_number", F.col("time_cycles").alias("final_cycle"), "true_rul")
    rows = test.join(F.broadcast(units), "unit_number", "left_semi").drop("true_rul")
    pred = rul.life_predictor(rows, rul.unit_lives(cyc))
    proj = rul.back_projected_truth(pred, final)
    return proj.select("unit_number", "time_cycles", round4("predicted_rul").alias("predicted_rul"),
                       "true_rul_extrapolated")


@register("group_folds", ids="M4", oracle=with_(CYCLES) + f"""
, unit AS (SELECT unit_number, count(*) AS n FROM cycles GROUP BY 1),
dealt AS (SELECT *, (row_number() OVER (ORDER BY n DESC, md5(CAST(unit_number AS VARCHAR)), unit_number) - 1) % {2 * C.CV_FOLDS} AS p FROM unit)
SELECT unit_number, n AS cycles, CAST(least(p, {2 * C.CV_FOLDS - 1} - p) AS INTEGER) AS fold FROM dealt""")
def q_group_folds(spark, sf_dir):
    folded = group_folds(cycles(spark, sf_dir))
    return folded.groupBy("unit_number", "fold").agg(F.count(F.lit(1)).alias("cycles"))


@register("distinct_units", ids="A3", oracle=with_(CYCLES, EVAL_SQL) + """
SELECT 'full' AS set_name, count(DISTINCT unit_number) AS n_units FROM cycles
UNION ALL SELECT 'test', count(DISTINCT unit_number) FROM test""")
def q_distinct_units(spark, sf_dir):
    cyc = cycles(spark, sf_dir)
    test = rul.truncate_units(cyc, KEEP)
    a = profile.distinct_units(cyc).select(F.lit("full").alias("set_name"), "n_units")
    b = profile.distinct_units(test).select(F.lit("test").alias("set_name"), "n_units")
    return a.unionByName(b)
