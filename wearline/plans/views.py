"""The adapters of ``wearline.sources.adapters`` written as DuckDB SQL views (oracle side)."""

EV = """ev AS (
    SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
)"""

READINGS = """raw_readings AS (
    SELECT event_id AS product_id,
           event_type AS machine_type,
           ts,
           295.0::DOUBLE + k % 10 AS air_temp_k,
           295.0::DOUBLE + k % 10 + 8.0::DOUBLE + hour(ts) % 5 AS process_temp_k,
           1200.0::DOUBLE + 15.0::DOUBLE * k AS rpm,
           value AS torque_nm,
           CAST((event_id * 7) % 250 AS DOUBLE) AS tool_wear_min
    FROM ev
),
flagged AS (
    SELECT *,
           CAST(tool_wear_min >= 240 AS INTEGER) AS twf,
           CAST((process_temp_k - air_temp_k) < 9 AND rpm < 1380 AS INTEGER) AS hdf,
           CAST(torque_nm * rpm > 300000 AS INTEGER) AS pwf,
           CAST(torque_nm * tool_wear_min > 20000 AS INTEGER) AS osf,
           CAST(product_id % 499 = 0 AS INTEGER) AS rnf
    FROM raw_readings
),
readings AS (
    SELECT *,
           greatest(twf, hdf, pwf, osf, rnf) AS machine_failure,
           (torque_nm * tool_wear_min / 11000.0::DOUBLE) / (1.0::DOUBLE + torque_nm * tool_wear_min / 11000.0::DOUBLE) AS risk
    FROM flagged
)"""

CYCLES = """cycles AS (
    SELECT user_id AS unit_number,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS time_cycles,
           value AS sensor_1,
           CAST(k AS DOUBLE) AS sensor_2,
           CAST(hour(ts) AS DOUBLE) AS sensor_3,
           5.0::DOUBLE AS sensor_4
    FROM ev
)"""

TELEMETRY = """telemetry AS (
    SELECT event_id AS tick_id,
           ts,
           user_id AS machine_id,
           event_type AS machine_type,
           295.0::DOUBLE + k % 10 AS air_temp_k,
           303.0::DOUBLE + k % 10 + hour(ts) % 5 AS process_temp_k,
           1200.0::DOUBLE + 15.0::DOUBLE * k AS rpm,
           value AS torque_nm,
           CAST(k % 4 AS INTEGER) AS production_inc,
           CAST(event_type = 'error' AS INTEGER) AS scrap_inc,
           CASE WHEN event_type = 'error' THEN value / 50.0::DOUBLE ELSE 0.0::DOUBLE END AS downtime_s,
           0.5::DOUBLE + (k % 21) / 10.0::DOUBLE AS wear_inc,
           event_type = 'signup' AS tool_change,
           60.0::DOUBLE + k % 36 AS spindle_load,
           115.0::DOUBLE + k % 34 AS hydraulic_pressure
    FROM ev
)"""

# Ranked queue over readings: score desc, ties by id (the order our Spark side uses).
RANKED = """ranked AS (
    SELECT *, row_number() OVER (ORDER BY risk DESC NULLS LAST, product_id ASC) AS queue_rank
    FROM readings
),
qtot AS (SELECT count(*) AS total_rows, CAST(sum(machine_failure) AS BIGINT) AS total_failures FROM readings)"""


def budgets(fractions) -> str:
    vals = ", ".join(f"({float(f)!r}::DOUBLE)" for f in fractions)
    return f"""budgets AS (
    SELECT b.review_fraction,
           greatest(1, CAST(ceil(t.total_rows * b.review_fraction) AS BIGINT)) AS reviewed_assets,
           t.total_rows, t.total_failures
    FROM (VALUES {vals}) b(review_fraction), qtot t
)"""


def with_(*ctes: str) -> str:
    """WITH clause; the ``ev`` base view is added first."""
    return "WITH " + ",\n".join((EV,) + ctes) + "\n"
