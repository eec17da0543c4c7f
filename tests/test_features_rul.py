"""Row features, run-to-failure windows and telemetry edge rows (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from wearline.operators import features, rul, telemetry


def test_derived_features_edges(spark):
    df = spark.createDataFrame([(298.0, 308.5, 1500.0, 0.0, 10.0), (298.0, 308.5, 1500.0, None, 10.0)],
                               "air_temp_k double, process_temp_k double, rpm double, torque_nm double, "
                               "tool_wear_min double")
    r = features.add_derived_features(df).collect()
    assert r[0].tool_wear_load_ratio == pytest.approx(10.0 / 1e-6)  # zero torque clipped
    assert r[1].tool_wear_load_ratio is None and r[1].mechanical_load is None  # NULL stays NULL
    assert r[0].thermal_stress == pytest.approx(10.5 / 298.0)


def test_stress_monotonicity(spark):
    # reference case: low stress (torque 40, wear 10) vs high stress (torque 75, wear 240)
    df = spark.createDataFrame([(1, "L", 298.0, 308.5, 1500.0, 40.0, 10.0), (2, "L", 298.0, 308.5, 1500.0, 75.0, 240.0)],
                               "id int, machine_type string, air_temp_k double, process_temp_k double, rpm double, "
                               "torque_nm double, tool_wear_min double")
    from wearline.streaming.jobs import live_scoring
    s = {r.id: r.risk for r in live_scoring(df).collect()}
    assert s[2] > s[1]


def test_rolling_short_units(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 1.0), (2, 2, 3.0), (2, 3, 5.0)],
                               "unit_number int, time_cycles int, sensor_1 double")
    r = {(x.unit_number, x.time_cycles): x for x in rul.add_rolling_features(df, ["sensor_1"], 5).collect()}
    assert r[(1, 1)].sensor_1_roll_std == 0.0 and r[(1, 1)].sensor_1_roll_mean == 5.0  # one cycle
    assert r[(2, 3)].sensor_1_roll_mean == 3.0 and r[(2, 3)].sensor_1_roll_std == pytest.approx(2.0)


def test_train_rul_cap_and_informative(spark):
    df = spark.range(1, 201).select(F.lit(7).alias("unit_number"), F.col("id").cast("int").alias("time_cycles"),
                                    F.lit(5.0).alias("sensor_4"), (F.col("id") * 0.5).alias("sensor_1"))
    r = rul.add_train_rul(df).orderBy("time_cycles").collect()
    assert r[0].rul == 125 and r[-1].rul == 0 and r[-50].rul == 49
    assert features.informative_columns(df, ["sensor_1", "sensor_4"]) == ["sensor_1"]


def test_trajectory_arrays_aligned(spark):
    rows = spark.createDataFrame([(1, c, 100.0 - c, 90.0 - c) for c in range(1, 6)],
                                 "unit_number int, time_cycles int, predicted_rul double, true_rul_extrapolated double")
    t = rul.trajectories(rows).first()
    assert len(t.cycles) == len(t.predicted_rul) == len(t.true_rul_extrapolated) == 5
    assert list(t.cycles) == [1, 2, 3, 4, 5]


def test_oee_floors(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00", 0, 0, 0.0), (2, "2024-01-01 01:10:00", 3, 5, 4000.0)],
                               "machine_id int, ts string, production_inc int, scrap_inc int, downtime_s double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    r = {x.production: x for x in telemetry.oee_by_window(df).collect()}
    assert r[0].quality == 100.0 and r[0].performance == 0.0  # nothing produced: quality 1
    assert r[3].quality == 0.0 and r[3].availability == pytest.approx(100 / 3600, abs=0.01)  # run floored at 1 s


def test_wear_reset(spark):
    df = spark.createDataFrame([(1, 1, "2024-01-01 00:00:01", 1.0, False), (1, 2, "2024-01-01 00:00:02", 2.0, False),
                                (1, 3, "2024-01-01 00:00:03", 5.0, True), (1, 4, "2024-01-01 00:00:04", 1.5, False)],
                               "machine_id int, tick_id int, ts string, wear_inc double, tool_change boolean")
    w = telemetry.wear_with_reset(df.withColumn("ts", F.col("ts").cast("timestamp")))
    assert [r.tool_wear_min for r in w.orderBy("tick_id").collect()] == [1.0, 3.0, 0.0, 1.5]


@pytest.mark.parametrize("nb", [None, 6])
def test_running_windows_bucketed_equal_plain(spark, nb):
    from pyspark.sql import Window
    from wearline.sources.adapters import telemetry as tele
    t = tele(spark, "/root/testdata/sf0.001")
    t = t.withColumn("machine_id", F.when(F.col("tick_id") % 3 == 0, F.lit(7)).otherwise(F.col("machine_id")))  # hot
    w = Window.partitionBy("machine_id").orderBy("ts", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    want = t.select("tick_id", F.sum("production_inc").over(w).cast("bigint").alias("p"),
                    F.round(F.sum("downtime_s").over(w), 6).alias("d"))
    got = telemetry.running_totals(t, n_buckets=nb).select("tick_id", F.col("production_total").alias("p"),
                                                            F.round("downtime_total_s", 6).alias("d"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    g = t.withColumn("_g", F.sum(F.col("tool_change").cast("int")).over(w))
    w2 = Window.partitionBy("machine_id", "_g").orderBy("ts", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    want2 = g.select("tick_id", F.round(F.sum(F.when(F.col("tool_change"), 0.0).otherwise(F.col("wear_inc")))
                                        .over(w2), 6).alias("w"))
    got2 = telemetry.wear_with_reset(t, n_buckets=nb).select("tick_id", F.round("tool_wear_min", 6).alias("w"))
    assert got2.exceptAll(want2).count() == 0 and want2.exceptAll(got2).count() == 0


@pytest.mark.parametrize("nb", [None, 4, 9])
def test_rolling_hot_unit_halo(spark, nb):
    from pyspark.sql import Window
    from wearline.sources.adapters import cycles
    c = cycles(spark, "/root/testdata/sf0.001")
    # one unit with a third of all rows: re-number its cycles so they stay unique
    c = c.withColumn("unit_number", F.when(F.col("unit_number") % 3 == 0, F.lit(999)).otherwise(F.col("unit_number")))
    c = c.withColumn("time_cycles", F.row_number().over(Window.partitionBy("unit_number").orderBy("time_cycles",
                                                                                                   "sensor_1")))
    w = Window.partitionBy("unit_number").orderBy("time_cycles").rowsBetween(-4, 0)
    want = c.select("unit_number", "time_cycles", F.round(F.avg("sensor_1").over(w), 9).alias("m"),
                    F.round(F.coalesce(F.stddev_samp("sensor_1").over(w), F.lit(0.0)), 9).alias("s"))
    got = rul.add_rolling_features(c, ["sensor_1"], 5, n_buckets=nb).select(
        "unit_number", "time_cycles", F.round("sensor_1_roll_mean", 9).alias("m"),
        F.round("sensor_1_roll_std", 9).alias("s"))
    assert got.count() == c.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_scale_conf_sizes():
    from wearline.session import scale_conf
    c = scale_conf(100 * 1024 ** 4)  # 100 TB
    assert c["spark.sql.shuffle.partitions"] == "200000" and c["spark.sql.files.maxPartitionBytes"] == "256m"
    small = scale_conf(10 * 1024 ** 3, executor_cores=8, executor_memory_gb=4)
    # 4 GB over 8 cores leaves ~307 MB per task: the target drops to a third of that
    assert small["spark.sql.files.maxPartitionBytes"] == "102m" and small["spark.sql.shuffle.partitions"] == "200"
