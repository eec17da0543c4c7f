"""Drift queries: readings before mid-January are the reference, later readings (with
tool wear advanced by the what-if shift) are the live batch; a second scenario draws
an exact-n bootstrap batch from all readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.operators import drift, features
from wearline.operators.rank import quantile_grid
from wearline.plans.registry import register
from wearline.plans.views import CYCLES, READINGS, with_
from wearline.sources.adapters import CATEGORICAL_FEATURES, DERIVED_FEATURES, NUMERIC_FEATURES, readings

CUTOFF = "2024-01-16 00:00:00"
NUMERIC = NUMERIC_FEATURES + DERIVED_FEATURES


def sides(spark, sf_dir):
    r = readings(spark, sf_dir)
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    ref = features.add_derived_features(r.filter(F.col("ts") < cut))
    cur = features.shift_feature(r.filter(F.col("ts") >= cut), "tool_wear_min", C.SHIFT_MINUTES)
    return ref, cur


def bootstrap_sides(spark, sf_dir):
    r = readings(spark, sf_dir)
    ref = features.add_derived_features(r)
    live = drift.bootstrap_sample(r, C.LIVE_BATCH_SIZE, C.RANDOM_SEED, "product_id")
    return ref, features.shift_feature(live, "tool_wear_min", C.SHIFT_MINUTES)


# --- SQL -------------------------------------------------------------------------------

def _derived(src: str, name: str, shift: bool = False) -> str:
    wear = f"tool_wear_min + {C.SHIFT_MINUTES!r}::DOUBLE" if shift else "tool_wear_min"
    return f"""{name}_s AS (SELECT * REPLACE ({wear} AS tool_wear_min) FROM {src}),
{name} AS (
    SELECT *, torque_nm * rpm AS mechanical_load,
           (process_temp_k - air_temp_k) / air_temp_k AS thermal_stress,
           tool_wear_min / (CASE WHEN torque_nm < 1e-6::DOUBLE THEN 1e-6::DOUBLE ELSE torque_nm END) AS tool_wear_load_ratio
    FROM {name}_s
)"""


SIDES_SQL = f"""ref_src AS (SELECT * FROM readings WHERE ts < TIMESTAMP '{CUTOFF}'),
cur_src AS (SELECT * FROM readings WHERE ts >= TIMESTAMP '{CUTOFF}'),
{_derived('ref_src', 'refd')},
{_derived('cur_src', 'curd', shift=True)}"""

BOOT_SQL = f"""ordered AS (SELECT *, row_number() OVER (ORDER BY product_id) AS ord FROM readings),
draws AS (
    SELECT ('0x' || substr(md5(CAST(j AS VARCHAR) || ':{C.RANDOM_SEED}'), 1, 15))::BIGINT
           % (SELECT count(*) FROM readings) + 1 AS ord
    FROM range({C.LIVE_BATCH_SIZE}) t(j)
),
live_src AS (SELECT o.* EXCLUDE (ord) FROM ordered o JOIN draws d USING (ord)),
{_derived('readings', 'refd')},
{_derived('live_src', 'curd', shift=True)}"""

FR = quantile_grid(C.PSI_BUCKETS, percent=True)
FEATS = ", ".join(NUMERIC)
NAMES = ", ".join(f"'{f}'" for f in NUMERIC)


def psi_sql() -> str:
    return f"""ref_long AS (UNPIVOT (SELECT {FEATS} FROM refd) ON {FEATS} INTO NAME feature VALUE value),
cur_long AS (UNPIVOT (SELECT {FEATS} FROM curd) ON {FEATS} INTO NAME feature VALUE value),
q AS (
    SELECT feature, list_sort(list_distinct(quantile_cont(value, [{', '.join(repr(f) for f in FR)}]))) AS bp
    FROM ref_long GROUP BY feature
),
edges AS (SELECT feature, len(bp) AS m, bp[2:len(bp) - 1] AS interior FROM q WHERE len(bp) >= 3),
both_sides AS (
    SELECT feature, value, 0 AS side FROM ref_long UNION ALL SELECT feature, value, 1 AS side FROM cur_long
),
binned AS (
    SELECT b.feature, b.side, len(list_filter(e.interior, lambda x: x <= b.value)) AS bin
    FROM both_sides b JOIN edges e USING (feature)
),
counts AS (
    SELECT feature, bin, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS ref_n,
           sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS cur_n
    FROM binned GROUP BY ALL
),
totals AS (SELECT feature, sum(ref_n) AS ref_total, sum(cur_n) AS cur_total FROM counts GROUP BY feature),
grid AS (SELECT feature, unnest(range(0, m - 1)) AS bin FROM edges),
cells AS (
    SELECT g.feature, coalesce(c.ref_n, 0) AS ref_n, coalesce(c.cur_n, 0) AS cur_n,
           coalesce(t.ref_total, 0) AS ref_total, coalesce(t.cur_total, 0) AS cur_total
    FROM grid g LEFT JOIN counts c USING (feature, bin) LEFT JOIN totals t USING (feature)
),
shares AS (
    SELECT feature, ref_total, cur_total,
           CASE WHEN ref_n / greatest(ref_total, 1) < 1e-4::DOUBLE THEN 1e-4::DOUBLE ELSE ref_n / greatest(ref_total, 1) END AS r,
           CASE WHEN cur_n / greatest(cur_total, 1) < 1e-4::DOUBLE THEN 1e-4::DOUBLE ELSE cur_n / greatest(cur_total, 1) END AS c
    FROM cells
),
per AS (
    SELECT feature, CASE WHEN min(least(ref_total, cur_total)) > 0 THEN sum((c - r) * ln(c / r)) ELSE 0.0 END AS psi
    FROM shares GROUP BY feature
),
npsi AS (
    SELECT n.feature, coalesce(p.psi, 0.0) AS psi
    FROM (SELECT unnest([{NAMES}]) AS feature) n LEFT JOIN per p USING (feature)
),
cat_both AS (
    SELECT machine_type AS category, 0 AS side FROM refd UNION ALL SELECT machine_type, 1 FROM curd
),
cat_tot AS (
    SELECT sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS ref_total, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS cur_total
    FROM cat_both
),
cat_cells AS (
    SELECT category, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS ref_n, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS cur_n
    FROM cat_both WHERE category IS NOT NULL GROUP BY category
),
cat_sh AS (
    SELECT CASE WHEN ref_n / greatest(ref_total, 1) < 1e-4::DOUBLE THEN 1e-4::DOUBLE ELSE ref_n / greatest(ref_total, 1) END AS r,
           CASE WHEN cur_n / greatest(cur_total, 1) < 1e-4::DOUBLE THEN 1e-4::DOUBLE ELSE cur_n / greatest(cur_total, 1) END AS c
    FROM cat_cells, cat_tot
),
cpsi AS (SELECT 'machine_type' AS feature, coalesce(sum((c - r) * ln(c / r)), 0.0) AS psi FROM cat_sh),
report AS (
    SELECT feature, round(psi, 4) AS psi,
           CASE WHEN psi >= 0.2 THEN 'significant_drift' WHEN psi >= 0.1 THEN 'moderate_drift'
                ELSE 'no_significant_drift' END AS verdict
    FROM (SELECT * FROM npsi UNION ALL SELECT * FROM cpsi)
)"""


@register("psi_numeric", ids="A13 A14 F7 F8 P21", oracle=with_(READINGS, SIDES_SQL, psi_sql()) +
          "SELECT feature, round(psi, 4) AS psi FROM npsi")
def q_psi_numeric(spark, sf_dir):
    ref, cur = sides(spark, sf_dir)
    return drift.numeric_psi(ref, cur, NUMERIC).select("feature", F.round("psi", 4).alias("psi"))


@register("psi_categorical", ids="A13 A15 U1", oracle=with_(READINGS, SIDES_SQL, psi_sql()) +
          "SELECT feature, round(psi, 4) AS psi FROM cpsi")
def q_psi_categorical(spark, sf_dir):
    ref, cur = sides(spark, sf_dir)
    return drift.categorical_psi(ref, cur, CATEGORICAL_FEATURES).select("feature", F.round("psi", 4).alias("psi"))


@register("drift_report", ids="A16 P10 T4 U3 F2", oracle=with_(READINGS, SIDES_SQL, psi_sql()) +
          "SELECT * FROM report ORDER BY psi DESC, feature")
def q_drift_report(spark, sf_dir):
    ref, cur = sides(spark, sf_dir)
    rep = drift.drift_report(ref, cur, NUMERIC, CATEGORICAL_FEATURES)
    return rep.orderBy(F.col("psi").desc(), "feature")


SUMMARY_SQL = """
SELECT (SELECT count(*) FROM refd) AS reference_rows, (SELECT count(*) FROM curd) AS live_batch_rows,
       count(*) > 0 AS drift_detected, count(*) AS n_drifted,
       coalesce(string_agg(feature, '|' ORDER BY psi DESC, feature), '') AS drifted_features
FROM report WHERE verdict <> 'no_significant_drift'"""


@register("drift_summary", ids="A16 P6", oracle=with_(READINGS, SIDES_SQL, psi_sql()) + SUMMARY_SQL)
def q_drift_summary(spark, sf_dir):
    ref, cur = sides(spark, sf_dir)
    rep = drift.drift_report(ref, cur, NUMERIC, CATEGORICAL_FEATURES)
    return drift.drift_summary(rep, ref, cur)


@register("bootstrap_drift", ids="U4 P21 A16", oracle=with_(READINGS, BOOT_SQL, psi_sql()) +
          "SELECT * FROM report ORDER BY psi DESC, feature")
def q_bootstrap_drift(spark, sf_dir):
    ref, live = bootstrap_sides(spark, sf_dir)
    rep = drift.drift_report(ref, live, NUMERIC, CATEGORICAL_FEATURES)
    return rep.orderBy(F.col("psi").desc(), "feature")


# --- R5 in batch form: PSI per daily window of the live side against the frozen reference ---

WINDOW_SQL = f"""cur_wlong AS (
    UNPIVOT (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, {FEATS} FROM curd)
    ON {FEATS} INTO NAME feature VALUE value
),
ref_bins AS (
    SELECT r.feature, len(list_filter(e.interior, lambda x: x <= r.value)) AS bin
    FROM ref_long r JOIN edges e USING (feature)
),
ref_cells AS (
    SELECT g.feature, g.bin, coalesce(c.n, 0) AS ref_n
    FROM grid g LEFT JOIN (SELECT feature, bin, count(*) AS n FROM ref_bins GROUP BY ALL) c USING (feature, bin)
),
ref_sh AS (SELECT feature, bin, ref_n / greatest(sum(ref_n) OVER (PARTITION BY feature), 1) AS ref_share FROM ref_cells),
cur_bins AS (
    SELECT c.window_start, c.feature, len(list_filter(e.interior, lambda x: x <= c.value)) AS bin
    FROM cur_wlong c JOIN edges e USING (feature)
),
cur_counts AS (SELECT window_start, feature, bin, count(*) AS n FROM cur_bins GROUP BY ALL),
cur_tot AS (SELECT window_start, feature, sum(n) AS cur_total FROM cur_counts GROUP BY ALL),
wcells AS (
    SELECT t.window_start, t.feature, r.bin, r.ref_share, coalesce(c.n, 0) / greatest(t.cur_total, 1) AS cur_share
    FROM cur_tot t JOIN ref_sh r USING (feature)
    LEFT JOIN cur_counts c ON c.window_start = t.window_start AND c.feature = t.feature AND c.bin = r.bin
)"""


#: A15 per window: shares of all rows of the window, NULL categories in the totals only
WINDOW_CATEGORICAL_SQL = """ckat AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, machine_type FROM curd),
cat_win AS (SELECT window_start, count(*) AS total FROM ckat GROUP BY 1),
cat_ref AS (SELECT machine_type AS category, count(*) / (SELECT count(*) FROM refd)::DOUBLE AS share FROM refd WHERE machine_type IS NOT NULL GROUP BY 1),
cat_all AS (SELECT category FROM cat_ref UNION SELECT machine_type FROM ckat WHERE machine_type IS NOT NULL),
cat_w AS (
    SELECT w.window_start, coalesce(r.share, 0.0) AS ref_share, (SELECT count(*) FROM ckat k WHERE k.window_start = w.window_start AND k.machine_type = a.category) / w.total::DOUBLE AS cur_share,
           r.share IS NULL AS fresh
    FROM cat_win w CROSS JOIN cat_all a LEFT JOIN cat_ref r ON r.category = a.category
)"""


@register("drift_by_window", ids="A13 A14 W1", oracle=with_(READINGS, SIDES_SQL, psi_sql(), WINDOW_SQL) + """
SELECT window_start, feature,
       round(sum((greatest(cur_share, 1e-4::DOUBLE) - greatest(ref_share, 1e-4::DOUBLE))
                 * ln(greatest(cur_share, 1e-4::DOUBLE) / greatest(ref_share, 1e-4::DOUBLE))), 4) AS psi
FROM wcells GROUP BY window_start, feature""")
def q_drift_by_window(spark, sf_dir):
    from wearline.streaming.jobs import frozen_histogram, psi_of_cells, windowed_cells
    ref, cur = sides(spark, sf_dir)
    edges, frozen = frozen_histogram(ref, NUMERIC, [])
    out = psi_of_cells(windowed_cells(cur, edges, [], window="1 day"), frozen)  # the streaming job's steps, run in batch
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "feature",
                      F.round("psi", 4).alias("psi"))


@register("dropped_sensors", ids="U2 P7 A18", oracle=with_(CYCLES) + """,
sstd AS (
    SELECT sensor, coalesce(stddev_samp(value) > 1e-5::DOUBLE, false) AS kept
    FROM (UNPIVOT (SELECT sensor_1, sensor_2, sensor_3, sensor_4 FROM cycles)
          ON sensor_1, sensor_2, sensor_3, sensor_4 INTO NAME sensor VALUE value)
    GROUP BY sensor
)
SELECT sensor FROM sstd EXCEPT ALL SELECT sensor FROM sstd WHERE kept""")
def q_dropped_sensors(spark, sf_dir):
    from wearline.operators.features import sensor_std_table
    from wearline.sources.adapters import SENSOR_COLUMNS, cycles
    t = sensor_std_table(cycles(spark, sf_dir), SENSOR_COLUMNS)
    return drift.dropped_columns(t, t.filter("kept"), "sensor")
