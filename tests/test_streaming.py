"""Structured Streaming jobs equal their batch twins (multi-batch, file source)."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF001
from wearline.operators import telemetry as T
from wearline.sources.adapters import telemetry
from wearline.streaming import jobs
from wearline.streaming.source import TELEMETRY_SCHEMA, read_telemetry_stream, write_stream


def _land_daily_files(spark, scratch):
    """Land the telemetry feed as one parquet file per day (in time order)."""
    t = telemetry(spark, SF001).select(*[f.name for f in TELEMETRY_SCHEMA.fields])
    days = [r[0] for r in t.select(F.to_date("ts")).distinct().orderBy(F.to_date("ts")).collect()]
    src = os.path.join(scratch, "feed")
    for i, d in enumerate(days[:6]):
        (t.filter(F.to_date("ts") == F.lit(d)).coalesce(1).write.mode("overwrite")
         .parquet(os.path.join(src, f"day={i:03d}")))
    # the stream reads the directory tree; one day per trigger
    return t.filter(F.to_date("ts") <= F.lit(days[5])), src


def _flat_source(spark, src):
    # file source over day folders: pass a glob so partition dirs are files of one stream
    return read_telemetry_stream(spark, os.path.join(src, "day=*"), max_files_per_trigger=1)


def test_wear_stream_equals_batch(spark, scratch):
    batch_in, src = _land_daily_files(spark, scratch)
    _closed(spark, batch_in).filter("machine_id = -1").coalesce(1).write.parquet(os.path.join(src, "day=999"))
    stream = jobs.wear_tracking(_flat_source(spark, src), watermark="1 second")
    q = write_stream(stream, "memory", "wear_out", os.path.join(scratch, "ck1"), mode="append")
    q.awaitTermination(300)
    got = spark.table("wear_out").filter("machine_id >= 0").select("tick_id", "machine_id", "tool_change",
                                         F.round("tool_wear_min", 6).alias("w"))
    want = T.wear_with_reset(batch_in).select("tick_id", "machine_id", "tool_change",
                                              F.round("tool_wear_min", 6).alias("w"))
    assert q.lastProgress is not None
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_recent_stream_equals_batch(spark, scratch):
    batch_in, src = _land_daily_files(spark, scratch)
    stream = jobs.recent_readings(_flat_source(spark, src), n=8)
    q = write_stream(stream, "memory", "recent_out", os.path.join(scratch, "ck2"), mode="update")
    q.awaitTermination(300)
    from pyspark.sql import Window
    out = spark.table("recent_out")
    newest = F.max("batch_seq").over(Window.partitionBy("machine_id"))
    got = (out.withColumn("_m", newest).filter(F.col("batch_seq") == F.col("_m"))
           .select("machine_id", "tick_id", "recency"))
    want = T.recent_n(batch_in, 8).select("machine_id", "tick_id", "recency")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_windowed_oee_matches_batch(spark, scratch):
    batch_in, src = _land_daily_files(spark, scratch)
    stream = jobs.windowed_oee(_flat_source(spark, src))
    q = write_stream(stream, "memory", "oee_out", os.path.join(scratch, "ck3"), mode="update")
    q.awaitTermination(300)
    out = spark.table("oee_out")
    # update mode emits a window again when it changes: keep the last emission per key
    got = out.groupBy("machine_id", "window_start").agg(F.max("production").alias("production"))
    want = T.oee_by_window(batch_in).select("machine_id", "window_start", "production")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_live_scoring_stream(spark, scratch):
    batch_in, src = _land_daily_files(spark, scratch)
    s = _flat_source(spark, src).withColumn("tool_wear_min", F.col("wear_inc") * 10)
    q = write_stream(jobs.live_scoring(s), "memory", "score_out", os.path.join(scratch, "ck4"))
    q.awaitTermination(300)
    out = spark.table("score_out")
    assert out.count() == batch_in.count()
    bad = out.filter((F.col("risk") < 0) | (F.col("risk") > 1) | (F.col("rul_hours") < 1)).count()
    assert bad == 0
    assert set(r[0] for r in out.select("risk_band").distinct().collect()) <= {"LOW", "MEDIUM", "HIGH"}


def test_live_scoring_with_fitted_model(spark, scratch):
    from wearline.ml import workflows as W
    from wearline.operators.features import add_derived_features
    from wearline.sources.adapters import CATEGORICAL_FEATURES, DERIVED_FEATURES, NUMERIC_FEATURES, readings
    train, test = W.split_frames(add_derived_features(readings(spark, SF001)))
    model, _, _ = W.fit_score("logistic", train, test, NUMERIC_FEATURES + DERIVED_FEATURES, CATEGORICAL_FEATURES,
                              maxIter=30)
    batch_in, src = _land_daily_files(spark, scratch)
    s = _flat_source(spark, src).withColumn("tool_wear_min", F.col("wear_inc") * 10)
    q = write_stream(jobs.live_scoring(s, model).select("tick_id", "risk", "rul_hours", "risk_band"),
                     "memory", "model_score_out", os.path.join(scratch, "ck6"))
    q.awaitTermination(300)
    mem = spark.table("model_score_out")
    got = {r.tick_id: r.risk for r in mem.collect()}
    want_df = jobs.live_scoring(batch_in.withColumn("tool_wear_min", F.col("wear_inc") * 10), model)
    want = {r.tick_id: r.risk for r in want_df.select("tick_id", "risk").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def _closed(spark, t):
    """The feed and a last tick of no machine far behind it, which lets the watermark pass all others."""
    end = t.agg(F.max("ts")).first()[0]
    last = t.limit(1).withColumns({"machine_id": F.lit(-1).cast("long"), "ts": (F.lit(end) + F.expr("INTERVAL 2 DAYS")).cast("timestamp")})
    return t.unionByName(last.select(*t.columns))


def test_wear_stream_takes_late_ticks_and_nulls(spark, scratch):
    """One second late inside the watermark, a NULL increment, an empty file."""
    cols = [f.name for f in TELEMETRY_SCHEMA.fields]
    t = telemetry(spark, SF001).select(*cols).withColumn("wear_inc", F.when(F.col("tick_id") % 7 == 0, F.lit(None)).otherwise(F.col("wear_inc")))
    day = _closed(spark, t)
    files = [t.filter("tick_id % 3 = 1"), t.filter("false"), t.filter("tick_id % 3 <> 1"), day.filter("machine_id = -1")]
    src = os.path.join(scratch, "late")
    for i, f in enumerate(files):
        f.coalesce(1).write.parquet(os.path.join(src, f"day={i}"))
    q = write_stream(jobs.wear_tracking(_flat_source(spark, src), watermark="100 days"), "memory", "late_out", os.path.join(scratch, "ckl"))
    q.awaitTermination(300)
    assert spark.table("late_out").count() == 0  # nothing has passed so long a watermark
    q = write_stream(jobs.wear_tracking(read_telemetry_stream(spark, os.path.join(src, "day=*")), watermark="1 second"), "memory", "all_out", os.path.join(scratch, "ckm"))
    q.awaitTermination(300)
    got = {(r.machine_id, r.tick_id): round(r.tool_wear_min, 9) for r in spark.table("all_out").collect()}
    want = {(r.machine_id, r.tick_id): round(r.tool_wear_min, 9) for r in T.wear_with_reset(t).collect()}
    assert {k: v for k, v in got.items() if k[0] != -1} == want


def test_drift_monitor_one_window_over_three_files(spark, scratch):
    """Cells that a batch does not touch keep their count; categories the reference lacks, NULLs and NaN are in their place."""
    batch_in, _ = _land_daily_files(spark, scratch)
    feats = ["torque_nm", "rpm"]
    odd = F.when(F.col("tick_id") % 11 == 0, F.lit(None)).when(F.col("tick_id") % 13 == 0, F.lit("new")).otherwise(F.col("machine_type"))
    edges, frozen = jobs.frozen_histogram(batch_in, feats, ["machine_type"])
    live = batch_in.withColumns({"machine_type": odd, "rpm": F.when(F.col("tick_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("rpm"))})

    def rounded(df):
        return {(r.window_start, r.feature): round(r.psi, 9) for r in df.collect()}

    want = rounded(jobs.psi_of_cells(jobs.windowed_cells(live, edges, ["machine_type"]), frozen))
    for name, order in (("in", [0, 1, 2]), ("out", [2, 0, 1])):
        src = os.path.join(scratch, f"thirds-{name}")
        for i, part in enumerate(order):
            live.filter(F.floor(F.hour("ts") / 8) == part).coalesce(1).write.parquet(os.path.join(src, f"day={i}"))
        out = os.path.join(scratch, f"psi-{name}")
        q = jobs.start_drift_monitor(_flat_source(spark, src), edges, frozen, ["machine_type"], out, os.path.join(scratch, f"ckd-{name}"), watermark="30 days")
        q.awaitTermination(300)
        assert rounded(jobs.current_drift(spark.read.parquet(out), frozen)) == want and len(want) == 18


def _feed(spark, folder, *files):
    cols = {f.name: f.dataType for f in TELEMETRY_SCHEMA.fields}
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "tick_id long, ts string, machine_id long, machine_type string, production_inc int, scrap_inc int, downtime_s double, wear_inc double, tool_change boolean")
        df = df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in cols.items()])
        df.coalesce(1).write.parquet(os.path.join(folder, f"day={i}"))
    return read_telemetry_stream(spark, os.path.join(folder, "day=*"), 1)


BIG = 9007199254740993
ODD = [[(BIG, "2024-01-01 00:00:00", 1, "a", 2, 0, 1.5, 1.0, False), (None, "2024-01-01 00:00:00", 1, "b", 1, 1, None, 2.0, None), (7, None, 1, "c", 9, 9, 9.0, 9.0, True)],
       [(BIG + 2, "2024-01-01 00:30:00", 1, "a", None, None, 0.5, None, True), (5, "2024-01-01 00:40:00", None, "n", 3, 0, 0.0, 4.0, False), (6, "2024-01-01 00:50:00", 1, "d", 0, 2, 0.0, 0.25, False)],
       [(1, "2024-03-01 00:00:00", 2, "late", 0, 0, 0.0, 1.0, False)],
       [(8, "2024-03-02 00:00:00", 1, "again", 4, 0, 0.0, 3.0, False)], [(9, "2024-06-01 00:00:00", -1, "end", 0, 0, 0.0, 0.0, False)]]


def test_null_ids_and_times(spark, scratch):
    """NULL ids stay NULL and come last of their time, ids keep all digits, ticks without time are left out."""
    q = write_stream(jobs.wear_tracking(_feed(spark, scratch + "/w", *ODD)), "memory", "odd_wear", scratch + "/ckw")
    q.awaitTermination(300)
    got = [(r.machine_id, r.tick_id, r.tool_wear_min) for r in spark.table("odd_wear").where("machine_id is null or machine_id > 0").orderBy("machine_id", "ts", F.col("tick_id").asc_nulls_last()).collect()]
    assert got == [(None, 5, 4.0), (1, BIG, 1.0), (1, None, 3.0), (1, BIG + 2, 0.0), (1, 6, 0.25), (1, 8, 3.25), (2, 1, 1.0)]


def test_last_readings_and_board_forget_silent_machines(spark, scratch):
    """After 30 silent days (of event time) a machine starts anew; NULL ids are in the lists."""
    q = write_stream(jobs.recent_readings(_feed(spark, scratch + "/r", *ODD), n=3), "memory", "odd_recent", scratch + "/ckr", mode="update")
    q.awaitTermination(300)
    rows = spark.table("odd_recent").where("machine_id = 1").collect()
    assert sorted((r.batch_seq, r.recency, repr(r.tick_id)) for r in rows) == [
        (1, 1, "8"), (1, 1, repr(BIG)), (1, 2, "None"), (2, 1, "6"), (2, 2, repr(BIG + 2)), (2, 3, repr(BIG))]
    q = write_stream(jobs.live_board(_feed(spark, scratch + "/b", *ODD), n=2), "memory", "odd_board", scratch + "/ckb", mode="update")
    q.awaitTermination(300)
    rows = spark.table("odd_board").where("machine_id = 1").orderBy("ts").collect()
    assert [(r.batch_seq, r.tick_id, r.production, r.scrap, r.downtime_s) for r in rows] == [(1, BIG, 3, 1, 1.5), (2, 6, 3, 3, 2.0), (1, 8, 4, 0, 0.0)]
    assert [[(e.tick_id, e.event) for e in r.events] for r in rows] == [[(None, "b")], [(6, "d"), (BIG + 2, "a")], []]
    assert rows[1].kinds == {"b": 1, "a": 1, "d": 1} and rows[2].kinds == {}


def test_a_model_published_between_batches_takes_over(spark, scratch):
    from wearline.plans.streams import closed_form_pipeline

    feed = _feed(spark, scratch + "/m", *[[(i, "2024-01-01 00:00:00", 1, "a", 0, 0, 0.0, 1.0, False)] for i in range(2)]).withColumns(
        {"torque_nm": F.lit(55.0), "tool_wear_min": F.lit(200.0), "air_temp_k": F.lit(300.0), "process_temp_k": F.lit(309.0), "rpm": F.lit(1.0)})
    args = (f"{scratch}/models", f"{scratch}/out", f"{scratch}/ck", ["tick_id", "risk"])
    import pytest

    with pytest.raises(Exception, match="no published model"):
        jobs.start_scoring(feed, f"{scratch}/none", f"{scratch}/o", f"{scratch}/c", ["tick_id"]).awaitTermination()
    jobs.publish_model(closed_form_pipeline(11000.0), args[0], 1)
    jobs.start_scoring(feed, *args).awaitTermination()
    (spark.read.schema(TELEMETRY_SCHEMA).parquet(scratch + "/m/day=0").withColumn("tick_id", F.lit(5).cast("long")).coalesce(1).write.parquet(scratch + "/m/day=7"))
    jobs.publish_model(closed_form_pipeline(5500.0), args[0], 2)
    jobs.start_scoring(feed, *args).awaitTermination()
    got = {r.tick_id: (r.model_version, r.risk) for r in spark.read.parquet(args[1]).collect()}
    assert got == {0: (1, 0.5), 1: (1, 0.5), 5: (2, 2 / 3)}


def test_ticks_of_no_machine_stay_with_it(spark, scratch):
    """A NULL machine among many in one batch: no other machine's list holds its ticks."""
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", None if i % 10 == 0 else i % 10, "a", 1, 0, 0.0, 1.0, False) for i in range(400)]
    q = write_stream(jobs.recent_readings(_feed(spark, scratch + "/n", rows), n=3), "memory", "null_recent", scratch + "/ckn", mode="update")
    q.awaitTermination(300)
    got = {}
    for r in spark.table("null_recent").collect():
        got.setdefault(r.machine_id or 0, []).append(r.tick_id)
    assert got.keys() == set(range(10)) and all(t % 10 == m for m, ticks in got.items() for t in ticks) and {len(t) for t in got.values()} == {3}
