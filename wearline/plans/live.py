"""Live-telemetry queries over the ``telemetry`` view (machine = user, tick = event)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import energy_cost_per_hour, gauge_band, kelvin_to_celsius, operator_name, shift_id
from wearline.operators import telemetry
from wearline.plans.registry import register
from wearline.plans.views import TELEMETRY, with_
from wearline.sources.adapters import telemetry as telemetry_view

FMT = "yyyy-MM-dd HH:mm:ss"
DFMT = "%Y-%m-%d %H:%M:%S"


WEAR_SQL = """wearg AS (
    SELECT *, sum(CAST(tool_change AS INTEGER)) OVER (PARTITION BY machine_id ORDER BY ts, tick_id
                                                     ROWS UNBOUNDED PRECEDING) AS grp
    FROM telemetry
),
wear AS (
    SELECT * EXCLUDE (grp),
           sum(CASE WHEN tool_change THEN 0.0 ELSE wear_inc END)
               OVER (PARTITION BY machine_id, grp ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING) AS wear
    FROM wearg
)"""


@register("running_totals", ids="W8", oracle=with_(TELEMETRY) + """
SELECT tick_id, machine_id,
       CAST(sum(production_inc) OVER w AS BIGINT) AS production_total,
       CAST(sum(scrap_inc) OVER w AS BIGINT) AS scrap_total,
       round(sum(downtime_s) OVER w, 4) AS downtime_total_s
FROM telemetry
WINDOW w AS (PARTITION BY machine_id ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING)""")
def q_running_totals(spark, sf_dir):
    r = telemetry.running_totals(telemetry_view(spark, sf_dir))
    return r.select("tick_id", "machine_id", "production_total", "scrap_total",
                    F.round("downtime_total_s", 4).alias("downtime_total_s"))


@register("wear_reset", ids="W9", oracle=with_(TELEMETRY, WEAR_SQL) +
          "SELECT tick_id, machine_id, tool_change, round(wear, 4) AS tool_wear_min FROM wear")
def q_wear_reset(spark, sf_dir):
    w = telemetry.wear_with_reset(telemetry_view(spark, sf_dir))
    return w.select("tick_id", "machine_id", "tool_change", F.round("tool_wear_min", 4).alias("tool_wear_min"))


@register("recent_n", ids="W7", oracle=with_(TELEMETRY) + f"""
SELECT machine_id, tick_id, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, tick_id DESC) AS INTEGER) AS recency
FROM telemetry QUALIFY recency <= {C.RECENT_READINGS}""")
def q_recent_n(spark, sf_dir):
    return telemetry.recent_n(telemetry_view(spark, sf_dir)).select("machine_id", "tick_id", "recency")


@register("recent_events", ids="W7", oracle=with_(TELEMETRY) + f"""
SELECT machine_id, tick_id, machine_type AS event,
       CAST(row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, tick_id DESC) AS INTEGER) AS recency
FROM telemetry WHERE tool_change OR scrap_inc > 0 QUALIFY recency <= {C.RECENT_EVENTS}""")
def q_recent_events(spark, sf_dir):
    """The last events (scrap, tool change) of each machine."""
    events = telemetry_view(spark, sf_dir).filter("tool_change or scrap_inc > 0")
    return telemetry.recent_n(events, C.RECENT_EVENTS).select("machine_id", "tick_id", F.col("machine_type").alias("event"), "recency")


@register("chart_points", ids="W7", oracle=with_(TELEMETRY) + f"""
SELECT machine_id, tick_id, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY ts, tick_id) AS INTEGER) AS position, torque_nm
FROM (SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, tick_id DESC) <= {C.CHART_POINTS})""")
def q_chart_points(spark, sf_dir):
    """The chart's sliding window: each machine's last points, oldest first."""
    from pyspark.sql import Window
    last = telemetry.recent_n(telemetry_view(spark, sf_dir), C.CHART_POINTS)
    position = F.row_number().over(Window.partitionBy("machine_id").orderBy(F.col("recency").desc()))
    return last.select("machine_id", "tick_id", position.cast("int").alias("position"), "torque_nm")


OEE_SQL = """og AS (
    SELECT machine_id, time_bucket(INTERVAL '1 hour', ts) AS window_start,
           CAST(sum(production_inc) AS BIGINT) AS production, CAST(sum(scrap_inc) AS BIGINT) AS scrap,
           sum(downtime_s) AS downtime_s
    FROM telemetry GROUP BY ALL
),
o1 AS (SELECT *, greatest(3600.0::DOUBLE - downtime_s, 1.0) AS run FROM og),
o2 AS (
    SELECT *, run / 3600.0::DOUBLE AS a, least(12.0::DOUBLE * production / run, 1.0) AS p,
           CASE WHEN production <> 0 THEN greatest(production - scrap, 0) / production::DOUBLE ELSE 1.0 END AS q
    FROM o1
)"""


@register("oee", ids="A24 F10", oracle=with_(TELEMETRY, OEE_SQL) + f"""
SELECT machine_id, strftime(window_start, '{DFMT}') AS window_start, production, scrap, round(downtime_s, 4) AS downtime_s,
       round(a * 100, 2) AS availability, round(p * 100, 2) AS performance, round(q * 100, 2) AS quality,
       round(a * p * q * 100, 2) AS oee
FROM o2""")
def q_oee(spark, sf_dir):
    o = telemetry.oee_by_window(telemetry_view(spark, sf_dir))
    return o.withColumn("window_start", F.date_format("window_start", FMT))


LIVE_SQL = WEAR_SQL + """,
live AS (
    SELECT *, torque_nm * tool_wear_min / 11000.0::DOUBLE AS x
    FROM (SELECT * REPLACE (wear AS tool_wear_min) FROM (SELECT *, 0.0::DOUBLE AS tool_wear_min FROM wear))
)"""


@register("risk_band", ids="P11 P15 P2", oracle=with_(TELEMETRY, LIVE_SQL) + f"""
SELECT tick_id, round(x / (1.0 + x), 4) AS risk_score,
       CASE WHEN x / (1.0 + x) * 100.0 < 30.0 THEN 'LOW' WHEN x / (1.0 + x) * 100.0 < 60.0 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_band,
       CAST(greatest(1, round_even({float(C.MAX_RUL_HOURS)!r}::DOUBLE * (1.0 - x / (1.0 + x)), 0)) AS BIGINT) AS rul_hours,
       CASE WHEN spindle_load > 90 THEN 'danger' WHEN spindle_load > 75 THEN 'warning' ELSE 'success' END AS spindle_band,
       CASE WHEN hydraulic_pressure > 140 THEN 'danger' WHEN hydraulic_pressure > 120 THEN 'warning' ELSE 'primary' END
           AS pressure_band
FROM live""")
def q_risk_band(spark, sf_dir):
    from wearline.streaming.jobs import live_scoring
    r = live_scoring(telemetry.wear_with_reset(telemetry_view(spark, sf_dir)))
    return r.select("tick_id", F.round("risk", 4).alias("risk_score"), "risk_band", "rul_hours",
                    gauge_band("spindle_load", C.SPINDLE_BANDS, "success").alias("spindle_band"),
                    gauge_band("hydraulic_pressure", C.PRESSURE_BANDS, "primary").alias("pressure_band"))


@register("shift", ids="P12 P16 F10", oracle=with_(TELEMETRY) + f"""
SELECT tick_id, strftime(ts, '%H:%M:%S') AS clock,
       CASE WHEN hour(ts) >= 8 AND hour(ts) < 20 THEN 'SHIFT-A' ELSE 'SHIFT-B' END AS shift_id,
       CASE WHEN hour(ts) >= 8 AND hour(ts) < 20 THEN 'John Doe' ELSE 'Jane Smith' END AS operator,
       round(process_temp_k - 273.15::DOUBLE, 1) AS temperature_c,
       round((3.0::DOUBLE + (tick_id % 20) / 10.0::DOUBLE) * 220.0::DOUBLE * 0.12::DOUBLE / 1000.0::DOUBLE, 4) AS energy_cost_per_hour
FROM telemetry""")
def q_shift(spark, sf_dir):
    t = telemetry_view(spark, sf_dir)
    current = F.lit(3.0) + (F.col("tick_id") % 20) / 10.0
    return t.select("tick_id", F.date_format("ts", "HH:mm:ss").alias("clock"), shift_id("ts").alias("shift_id"),
                    operator_name("ts").alias("operator"),
                    F.round(kelvin_to_celsius("process_temp_k"), 1).alias("temperature_c"),
                    F.round(energy_cost_per_hour(current, F.lit(220.0)), 4).alias("energy_cost_per_hour"))
