"""The streaming jobs as bounded, checkable runs: the telemetry of ``events`` is landed as files in the
shared folder, four quarters of its time one after another, ``availableNow`` runs read a quarter as a micro-batch (so that
states are read back), and what their sinks hold is the result.

The feed ends with one tick of no machine two days later, so that the watermark passes every real tick
and window. The oracles are the batch definitions."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.plans import drift as drift_plans
from wearline.plans.live import DFMT, FMT, OEE_SQL, WEAR_SQL
from wearline.plans.registry import register
from wearline.plans.views import READINGS, TELEMETRY, with_
from wearline.session import ensure_checkpoint_dir, stage
from wearline.sources.adapters import CATEGORICAL_FEATURES
from wearline.sources.adapters import telemetry as telemetry_view
from wearline.streaming import jobs
from wearline.streaming.source import TELEMETRY_SCHEMA, read_telemetry_stream, write_stream

END_OF_FEED = -1  # machine of the closing tick
QUARTERS = 4
ROWS_PER_FILE = 2_000_000


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wearline-stream-{uuid.uuid4().hex}"


class Feed:
    """Telemetry on its way to ``folder``, a quarter of its time at once, each as the same number of files."""

    def __init__(self, spark, sf_dir, folder: str):
        self.spark, self.folder = spark, folder
        t = telemetry_view(spark, sf_dir).select(*[f.name for f in TELEMETRY_SCHEMA.fields])
        lo, hi, n = t.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count("*")).first()
        self.last, self.files = hi, max(1, -(-n // (QUARTERS * ROWS_PER_FILE)))
        micros = F.unix_micros("ts")
        self.rows = stage(t.withColumn("quarter", F.call_function("div", (micros - F.lit(lo)) * QUARTERS, F.lit((hi or 0) - (lo or 0) + 1)).cast("int")), "feed")

    def land(self, *quarters: int) -> None:
        for q in quarters:
            part = self.rows.where(F.col("quarter") == q).drop("quarter")
            part.repartitionByRange(self.files, "ts").write.parquet(f"{self.folder}/feed/part={q}") if self.files > 1 else part.coalesce(1).write.parquet(f"{self.folder}/feed/part={q}")

    def close(self) -> None:
        kinds = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in TELEMETRY_SCHEMA.fields}
        kinds["machine_id"] = F.lit(END_OF_FEED).cast("long").alias("machine_id")
        kinds["ts"] = (F.timestamp_micros(F.lit(self.last or 0).cast("bigint")) + F.expr("INTERVAL 2 DAYS")).alias("ts")
        self.spark.range(1).select(*kinds.values()).coalesce(1).write.parquet(f"{self.folder}/feed/part={QUARTERS}")

    def stream(self):
        """One quarter a micro-batch."""
        return read_telemetry_stream(self.spark, f"{self.folder}/feed/part=*", self.files)


def _land(spark, sf_dir, folder: str):
    feed = Feed(spark, sf_dir, folder)
    feed.land(*range(QUARTERS))
    feed.close()
    return feed.stream()


def _run(spark, stream, folder: str):
    """Run the query to its end into a parquet sink and read it."""
    write_stream(stream, "parquet", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _updates(spark, stream, folder: str):
    """Run a query in update mode and keep, of every machine, what it gave out last."""
    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    (stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
     .foreachBatch(keep).trigger(availableNow=True).start().awaitTermination())
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out").where(F.col("machine_id") != END_OF_FEED)
    newest = out.groupBy("machine_id").agg(F.max("batch_seq").alias("batch_seq"))
    return out.join(newest, ["machine_id", "batch_seq"])


def closed_form_pipeline(scale: float) -> PipelineModel:
    """A pipeline whose scores SQL can state: x / (1 + x) with x = torque * wear / ``scale``, as the class probabilities."""
    score = f"SELECT *, x / (1.0D + x) AS _yes, 1.0D - x / (1.0D + x) AS _no FROM (SELECT *, torque_nm * tool_wear_min / {scale!r}D AS x FROM __THIS__)"
    return PipelineModel([SQLTransformer(statement=score), VectorAssembler(inputCols=["_no", "_yes"], outputCol="probability", handleInvalid="keep")])


#: scale of the first and of the second published model
SCALES = (11000.0, 9000.0)


@register("stream_risk", ids="R1 S7 S8 S9 M14", oracle=with_(TELEMETRY) + f"""
, span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM telemetry),
live AS (
    SELECT tick_id, CASE WHEN (epoch_us(ts) - lo) * {QUARTERS} // (hi - lo + 1) < {QUARTERS // 2} THEN 1 ELSE 2 END AS model_version, torque_nm * wear_inc AS p FROM telemetry, span),
x AS (SELECT *, p / CASE WHEN model_version = 1 THEN {SCALES[0]!r}::DOUBLE ELSE {SCALES[1]!r}::DOUBLE END AS x FROM live)
SELECT tick_id, CAST(model_version AS INTEGER) AS model_version, round(x / (1.0 + x), 6) AS risk,
       CASE WHEN x / (1.0 + x) * 100.0 < 30.0 THEN 'LOW' WHEN x / (1.0 + x) * 100.0 < 60.0 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_band,
       CAST(greatest(1, round_even({float(C.MAX_RUL_HOURS)!r}::DOUBLE * (1.0 - x / (1.0 + x)), 0)) AS BIGINT) AS rul_hours
FROM x""")
def q_stream_risk(spark, sf_dir):
    """A saved pipeline scores the feed; a second version is published half-way, and a run resumed at the checkpoint takes it up."""
    folder = _folder(spark)
    feed = Feed(spark, sf_dir, folder)
    for version, quarters in ((1, range(QUARTERS // 2)), (2, range(QUARTERS // 2, QUARTERS))):
        jobs.publish_model(closed_form_pipeline(SCALES[version - 1]), f"{folder}/models", version)
        feed.land(*quarters)
        live = feed.stream().withColumn("tool_wear_min", F.col("wear_inc"))
        jobs.start_scoring(live, f"{folder}/models", f"{folder}/out", f"{folder}/checkpoint", ["tick_id", "risk", "risk_band", "rul_hours"]).awaitTermination()
    out = spark.read.schema("tick_id bigint, risk double, risk_band string, rul_hours bigint, model_version int").parquet(f"{folder}/out")
    return out.drop("batch_id").withColumn("risk", F.round("risk", 6))


@register("stream_oee", ids="R2", oracle=with_(TELEMETRY, OEE_SQL) + f"""
SELECT machine_id, strftime(window_start, '{DFMT}') AS window_start, production, scrap, round(downtime_s, 4) AS downtime_s,
       round(a * 100, 2) AS availability, round(p * 100, 2) AS performance, round(q * 100, 2) AS quality,
       round(a * p * q * 100, 2) AS oee
FROM o2""")
def q_stream_oee(spark, sf_dir):
    folder = _folder(spark)
    out = _run(spark, jobs.windowed_oee(_land(spark, sf_dir, folder)), folder)
    return out.filter(F.col("machine_id") != END_OF_FEED).withColumn("window_start", F.date_format("window_start", FMT))


@register("stream_wear", ids="R3", oracle=with_(TELEMETRY, WEAR_SQL) +
          "SELECT tick_id, machine_id, tool_change, round(wear, 4) AS tool_wear_min FROM wear")
def q_stream_wear(spark, sf_dir):
    folder = _folder(spark)
    out = _run(spark, jobs.wear_tracking(_land(spark, sf_dir, folder)), folder)
    return out.filter(F.col("machine_id") != END_OF_FEED).select(
        "tick_id", "machine_id", "tool_change", F.round("tool_wear_min", 4).alias("tool_wear_min"))


@register("stream_recent", ids="R4", oracle=with_(TELEMETRY) + f"""
SELECT machine_id, tick_id, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, tick_id DESC) AS INTEGER) AS recency
FROM telemetry QUALIFY recency <= {C.RECENT_READINGS}""")
def q_stream_recent(spark, sf_dir):
    folder = _folder(spark)
    return _updates(spark, jobs.recent_readings(_land(spark, sf_dir, folder)), folder).select("machine_id", "tick_id", "recency")


@register("stream_events", ids="R4 W7", oracle=with_(TELEMETRY) + f"""
, event AS (SELECT machine_id, tick_id, machine_type AS event, ts FROM telemetry WHERE tool_change OR scrap_inc > 0),
kinds AS (SELECT machine_id, event, count(*) AS of_kind FROM event GROUP BY ALL)
SELECT machine_id, tick_id, event, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, tick_id DESC) AS INTEGER) AS recency, of_kind
FROM event JOIN kinds USING (machine_id, event) QUALIFY recency <= {C.RECENT_EVENTS}""")
def q_stream_events(spark, sf_dir):
    """The last events of each machine from list state, with the number of their kind from map state."""
    folder = _folder(spark)
    board = _updates(spark, jobs.live_board(_land(spark, sf_dir, folder)), folder)
    each = board.select("machine_id", "kinds", F.posexplode("events").alias("at", "e"))
    return each.select("machine_id", "e.tick_id", "e.event", (F.col("at") + 1).cast("int").alias("recency"), F.element_at("kinds", F.col("e.event")).alias("of_kind"))


@register("stream_production", ids="R4 A24 W8", oracle=with_(TELEMETRY) + """
, t AS (
    SELECT machine_id, CAST(sum(production_inc) AS BIGINT) AS production, CAST(sum(scrap_inc) AS BIGINT) AS scrap, sum(downtime_s) AS d,
           greatest((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE, 1.0) AS elapsed, arg_max(tick_id, struct_pack(ts := ts, k := tick_id)) AS tick_id
    FROM telemetry GROUP BY machine_id),
r AS (SELECT *, greatest(elapsed - d, 1.0) AS run FROM t),
o AS (
    SELECT *, run / elapsed AS a, least(12.0::DOUBLE * production / run, 1.0) AS p,
           CASE WHEN production <> 0 THEN greatest(production - scrap, 0) / production::DOUBLE ELSE 1.0 END AS q FROM r)
SELECT machine_id, tick_id, production, scrap, round(d, 4) AS downtime_s, round(a * 100, 2) AS availability, round(p * 100, 2) AS performance,
       round(q * 100, 2) AS quality, round(a * p * q * 100, 2) AS oee
FROM o""")
def q_stream_production(spark, sf_dir):
    """Each machine's latest tick and its production figures since the first one, from value state."""
    folder = _folder(spark)
    board = _updates(spark, jobs.live_board(_land(spark, sf_dir, folder)), folder)
    stats = jobs.production_stats(board).drop("batch_seq").withColumn("downtime_s", F.round("downtime_s", 4))
    return stats.join(board.select("machine_id", "tick_id"), "machine_id")


@register("stream_drift", ids="R5 A15", oracle=with_(READINGS, drift_plans.SIDES_SQL, drift_plans.psi_sql(), drift_plans.WINDOW_SQL, drift_plans.WINDOW_CATEGORICAL_SQL) + """
, parts AS (
    SELECT window_start, feature, ref_share, cur_share FROM wcells
    UNION ALL SELECT window_start, 'machine_type', ref_share, cur_share FROM cat_w WHERE NOT fresh OR cur_share > 0)
SELECT window_start, feature,
       round(sum((greatest(cur_share, 1e-4::DOUBLE) - greatest(ref_share, 1e-4::DOUBLE))
                 * ln(greatest(cur_share, 1e-4::DOUBLE) / greatest(ref_share, 1e-4::DOUBLE))), 4) AS psi
FROM parts GROUP BY window_start, feature""")
def q_stream_drift(spark, sf_dir):
    """All numeric and categorical features; each window comes in two files and two micro-batches."""
    folder = _folder(spark)
    ref, cur = drift_plans.sides(spark, sf_dir)
    edges, frozen = jobs.frozen_histogram(ref, drift_plans.NUMERIC, CATEGORICAL_FEATURES)
    live = cur.select(F.col("ts").cast("timestamp").alias("ts"), *drift_plans.NUMERIC, *CATEGORICAL_FEATURES)
    for part in (0, 1):
        live.where(F.hour("ts") % 2 == part).coalesce(1).write.parquet(f"{folder}/feed/part={part}")
    feed = spark.readStream.schema(live.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed/part=*")
    jobs.start_drift_monitor(feed, edges, frozen, CATEGORICAL_FEATURES, f"{folder}/out", f"{folder}/checkpoint", watermark="400 days").awaitTermination()
    sink = spark.read.parquet(f"{folder}/out")
    return jobs.current_drift(sink, frozen).select(F.date_format("window_start", FMT).alias("window_start"), "feature", F.round("psi", 4).alias("psi"))
