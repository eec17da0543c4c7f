"""Live-telemetry operators in batch form (their streaming twins are in ``wearline.streaming``).

W7 last-N per machine, W8 running totals, W9 wear with reset on tool change, A24 OEE,
P11 risk band, P12 shift, P15 heuristic RUL, P16 unit conversions.
Every window is partitioned by machine: one exchange on ``machine_id`` serves all of
them (a finer (machine, group) window reuses that partitioning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.operators.rank import running_sums, segmented_sum

MACHINE, TS, TICK = "machine_id", "ts", "tick_id"


def running_totals(df: DataFrame, machine: str = MACHINE, ts: str = TS, tick: str = TICK,
                   n_buckets: int | None = None) -> DataFrame:
    """Running production, scrap and downtime per machine in (ts, tick) order.

    Exact running sums through ``rank.running_sums``: a machine that holds a large share of
    all ticks is cut into time-range buckets with exact offsets, not sent to one task."""
    r = running_sums(df, ts, {"production_total": "production_inc", "scrap_total": "scrap_inc",
                              "downtime_total_s": "downtime_s"}, tie=tick, by=[machine], n_buckets=n_buckets)
    return r.withColumns({"production_total": F.col("production_total").cast("bigint"),
                          "scrap_total": F.col("scrap_total").cast("bigint")})


def wear_with_reset(df: DataFrame, machine: str = MACHINE, ts: str = TS, tick: str = TICK,
                    n_buckets: int | None = None) -> DataFrame:
    """Wear accumulates ``wear_inc`` per tick (NULL counts 0) and is 0 at a tool change; the tick
    after a change starts again from its own increment. One segmented sum (``rank.segmented_sum``), so
    neither a hot machine nor a long stretch without tool change lands in one task."""
    return segmented_sum(df, ts, "wear_inc", "tool_change", "tool_wear_min", tie=tick, by=[machine], n_buckets=n_buckets)


def recent_n(df: DataFrame, n: int = C.RECENT_READINGS, machine: str = MACHINE, ts: str = TS,
             tick: str = TICK) -> DataFrame:
    """The last ``n`` ticks per machine (WindowGroupLimit keeps n rows per task)."""
    w = Window.partitionBy(machine).orderBy(F.col(ts).desc(), F.col(tick).desc())
    return df.withColumn("recency", F.row_number().over(w).cast("int")).filter(F.col("recency") <= n)


def oee_columns(production: str, scrap: str, downtime: str, elapsed: F.Column) -> dict[str, F.Column]:
    """A24 with the reference floors: elapsed >= 1 s, run >= 1 s, performance <= 1,
    good >= 0, quality 1 when nothing was produced; ideal cycle 12 s."""
    el = F.greatest(elapsed.cast("double"), F.lit(1.0))
    run = F.greatest(el - F.col(downtime), F.lit(1.0))
    availability = run / el
    performance = F.least(F.lit(C.IDEAL_CYCLE_TIME_SECONDS) * F.col(production) / run, F.lit(1.0))
    good = F.greatest(F.col(production) - F.col(scrap), F.lit(0))
    quality = F.when(F.col(production) != 0, good / F.col(production).cast("double")).otherwise(F.lit(1.0))
    oee = availability * performance * quality
    return {
        "availability": F.round(availability * 100, 2),
        "performance": F.round(performance * 100, 2),
        "quality": F.round(quality * 100, 2),
        "oee": F.round(oee * 100, 2),
    }


def oee_by_window(df: DataFrame, window: str = "1 hour", machine: str = MACHINE, ts: str = TS) -> DataFrame:
    """A24 per machine and tumbling window: production, scrap, downtime summed, elapsed =
    window length. ``window()`` is the same grouping the streaming job uses."""
    g = (df.groupBy(machine, F.window(ts, window).alias("w"))
         .agg(F.sum("production_inc").cast("bigint").alias("production"),
              F.sum("scrap_inc").cast("bigint").alias("scrap"),
              F.sum("downtime_s").alias("downtime_s")))
    elapsed = F.col("w.end").cast("long") - F.col("w.start").cast("long")
    return g.select(machine, F.col("w.start").alias("window_start"), "production", "scrap",
                    F.round("downtime_s", 4).alias("downtime_s"),
                    *[v.alias(k) for k, v in oee_columns("production", "scrap", "downtime_s", elapsed).items()])
