"""Budgeted review queues: W5 review queue, W10 capture curve, T3 top of queue,
A20 failure-mode capture, Q3 queue ROI."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import failure_label, round4, safe_div, safe_div0
from wearline.operators.rank import global_row_number

QUEUE_RANK = "queue_rank"


def rank_queue(scored: DataFrame, score: str = "risk", id_col: str = "product_id",
               n_buckets: int | None = None) -> tuple[DataFrame, int]:
    """Add ``queue_rank``: 1-based position by score descending, ties by id ascending.

    Returns ``(ranked, n_rows)``. Exact and distributed (bucketed rank); the
    reference's unstable sort leaves ties at the cut arbitrary, ours breaks them by id.
    The one driver-side step is a row count (one number).
    """
    n_rows = scored.count()
    ranked = global_row_number(scored, score, descending=True, tie=id_col, out=QUEUE_RANK,
                               n_buckets=n_buckets, n_rows=n_rows)
    return ranked, n_rows


def budget_size(n_rows: int, fraction: float) -> int:
    """n = max(1, ceil(N * f)) in double arithmetic, as the reference computes it."""
    return max(1, math.ceil(n_rows * float(fraction)))


def queue_counts(ranked: DataFrame, n_rows: int, fractions: list[float], label: str = "machine_failure",
                 extra_flags: list[str] | tuple = ()) -> DataFrame:
    """One aggregate pass over the ranked rows: failures inside each budget.

    Output: one row per fraction with ``review_fraction, total_rows, total_failures,
    reviewed_assets, captured_failures`` plus ``total_<flag>`` / ``captured_<flag>``.
    """
    aggs = [F.sum(F.col(label)).cast("bigint").alias("total_failures")]
    aggs += [F.sum(F.col(f)).cast("bigint").alias(f"total_{f}") for f in extra_flags]
    for i, f in enumerate(fractions):
        inside = F.col(QUEUE_RANK) <= F.lit(budget_size(n_rows, f))
        aggs.append(F.sum(F.when(inside, 1).otherwise(0)).cast("bigint").alias(f"_rev{i}"))
        aggs.append(F.sum(F.when(inside, F.col(label)).otherwise(0)).cast("bigint").alias(f"_cap{i}"))
        for fl in extra_flags:
            aggs.append(F.sum(F.when(inside, F.col(fl)).otherwise(0)).cast("bigint").alias(f"_cap{i}_{fl}"))
    row = ranked.agg(*aggs).withColumn("total_rows", F.lit(n_rows).cast("bigint"))
    stack = []
    for i, f in enumerate(fractions):
        stack.append(F.struct(
            F.lit(float(f)).alias("review_fraction"),
            F.col(f"_rev{i}").alias("reviewed_assets"),
            F.col(f"_cap{i}").alias("captured_failures"),
            *[F.col(f"_cap{i}_{fl}").alias(f"captured_{fl}") for fl in extra_flags],
        ))
    keep = ["total_rows", "total_failures"] + [f"total_{fl}" for fl in extra_flags]
    return row.select(*keep, F.inline(F.array(*stack)))


def queue_counts_by_selection(scored: DataFrame, fractions: list[float], score: str = "risk",
                              label: str = "machine_failure", id_col: str = "product_id",
                              extra_flags: list[str] | tuple = (), n_buckets: int | None = None) -> DataFrame:
    """Same output as ``queue_counts`` without ranking every row. An empty input gives no rows.

    The order is (score desc, id asc). ``selection.cut`` finds the row at every budget's end by counting; its score and id
    then stand as literals in one aggregate over the rows, whose result is one row. The table is scanned
    and never shuffled or sorted. Of rows equal in score and id those without a flag come first.
    """
    from wearline.operators import rank
    from wearline.operators import selection as S

    cols = [label, *extra_flags]
    d = scored.select(id_col, score, *cols)
    keys = S.order_keys(d, score, descending=True, tie=id_col)
    if keys is None:  # keys of a type that counting has no intervals for
        ranked, n_rows = rank_queue(d, score, id_col, n_buckets)
        return queue_counts(ranked, n_rows, fractions, label, extra_flags)
    budget = rank.ROWS_PER_BUCKET if not n_buckets else max(1, -(-d.count() // n_buckets))
    ends = S.cut(d, keys, lambda sizes: [[min(budget_size(sizes[0], f), sizes[0]) for f in fractions]], budget=budget)
    n_rows = ends.sizes[0]
    if not n_rows:  # nothing to review: no rows
        return queue_counts(d.withColumn(QUEUE_RANK, F.lit(0)), 0, fractions, label, extra_flags).limit(0)
    sizes = [min(budget_size(n_rows, f), n_rows) for f in fractions]
    aggs = [F.sum(c).cast("bigint").alias(f"total_{c}") for c in cols]
    for i, b in enumerate(sizes):
        inside, level = ends.before(0, b), ends.level(0, b)
        aggs += [F.count_if(inside).alias(f"_n{i}"), F.count_if(level).alias(f"_e{i}")]
        aggs += [F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).cast("bigint").alias(f"_{x}{i}_{c}") for c in cols for x, w in (("s", inside), ("t", level))]

    def taken(i: int, b: int, c: str):
        """Flags before the cut and those of its level rows that still fit."""
        return F.col(f"_s{i}_{c}") + F.greatest(F.lit(0), F.lit(b) - F.col(f"_n{i}") - F.col(f"_e{i}") + F.col(f"_t{i}_{c}"))

    budgets = [F.struct(F.lit(float(f)).alias("review_fraction"), F.lit(b).cast("bigint").alias("reviewed_assets"),
                        *[taken(i, b, c).cast("bigint").alias(f"captured_{c}") for c in cols]) for i, (f, b) in enumerate(zip(fractions, sizes, strict=True))]
    out = d.agg(*aggs).select(*[f"total_{c}" for c in cols], F.inline(F.array(*budgets)))
    return out.select(F.lit(n_rows).cast("bigint").alias("total_rows"), F.col(f"total_{label}").alias("total_failures"), *[f"total_{c}" for c in extra_flags],
                      "review_fraction", "reviewed_assets", F.col(f"captured_{label}").alias("captured_failures"), *[f"captured_{c}" for c in extra_flags])


def review_queue(scored: DataFrame, score: str = "risk", label: str = "machine_failure",
                 id_col: str = "product_id", fractions: list[float] | None = None,
                 n_buckets: int | None = None) -> DataFrame:
    """Per budget the reviewed count, captures, capture rate, yields and lift."""
    fractions = fractions or C.REVIEW_FRACTIONS
    q = queue_counts_by_selection(scored, fractions, score, label, id_col, n_buckets=n_buckets)
    base = safe_div0(F.col("total_failures"), F.col("total_rows"))
    yld = F.col("captured_failures") / F.col("reviewed_assets")
    return q.select(
        "review_fraction",
        "reviewed_assets",
        "captured_failures",
        round4(safe_div0(F.col("captured_failures"), F.col("total_failures"))).alias("failure_capture_rate"),
        round4(yld).alias("review_yield"),
        round4(base).alias("random_review_yield"),
        round4(F.when(base != 0, yld / base).otherwise(F.lit(0.0))).alias("yield_lift_vs_random"),
    )


def queue_roi(budgets: DataFrame) -> DataFrame:
    """Q3: review-queue ROI per budget level, in percent presentation."""
    def percent(c: str, places: int):
        return F.round(100 * F.col(c), places)

    per_catch = safe_div(F.col("reviewed_assets").cast("double"), F.col("captured_failures"))
    return budgets.select(percent("review_fraction", 0).alias("review_budget_pct"), "reviewed_assets", "captured_failures",
                          percent("failure_capture_rate", 1).alias("failure_capture_rate_pct"),
                          F.round("yield_lift_vs_random", 2).alias("yield_lift_vs_random"), F.round(per_catch, 1).alias("assets_per_failure_caught"))


def capture_curve(scored: DataFrame, fractions: list[float], score: str = "risk",
                  label: str = "machine_failure", id_col: str = "product_id",
                  n_buckets: int | None = None) -> DataFrame:
    """Cumulative capture at each fraction, with the (0, 0) origin and the random diagonal."""
    q = queue_counts_by_selection(scored, fractions, score, label, id_col, n_buckets=n_buckets)
    pts = q.select(
        F.col("review_fraction").alias("fraction"),
        round4(safe_div0(F.col("captured_failures"), F.col("total_failures"))).alias("capture"),
        F.col("review_fraction").alias("random_line"),
    )
    origin = q.sparkSession.range(1).select(F.lit(0.0).alias("fraction"), F.lit(0.0).alias("capture"),
                                            F.lit(0.0).alias("random_line"))
    return origin.unionByName(pts)


def top_queue(scored: DataFrame, n: int = C.TOP_QUEUE_ASSETS, score: str = "risk",
              id_col: str = "product_id", flag_cols: dict[str, str] | None = None) -> DataFrame:
    """The first ``n`` assets of the queue with their failure labels.

    ``orderBy().limit(n)`` plans as ``TakeOrderedAndProject``: each task keeps n rows.
    """
    from wearline.functions.columns import flags_to_labels
    from wearline.operators.rank import cleaned
    return (scored.orderBy(cleaned(scored, score).desc_nulls_last(), F.col(id_col).asc_nulls_last())
            .limit(n)
            .select(F.col(id_col), round4(score).alias("risk_score"),
                    F.col("machine_failure").cast("int").alias("machine_failure"),
                    flags_to_labels(flag_cols).alias("failure_modes")))


def failure_mode_capture(scored: DataFrame, fraction: float = C.PRIMARY_REVIEW_FRACTION,
                         score: str = "risk", id_col: str = "product_id",
                         flag_cols: dict[str, str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Per failure mode, holdout failures and those inside the shared queue."""
    flag_cols = flag_cols or {c: c.lower() for c in C.FAILURE_CODES}
    flags = list(flag_cols.values())
    q = queue_counts_by_selection(scored, [fraction], score, "machine_failure", id_col, flags, n_buckets)
    rows = [F.struct(F.lit(code).alias("failure_code"),
                     F.col("reviewed_assets"),
                     F.col(f"total_{fl}").alias("holdout_failures"),
                     F.col(f"captured_{fl}").alias("captured_in_top_10_percent_queue"))
            for code, fl in flag_cols.items()]
    out = q.select(F.inline(F.array(*rows)))
    return out.select(
        "failure_code",
        failure_label(F.col("failure_code")).alias("label"),
        "reviewed_assets",
        "holdout_failures",
        "captured_in_top_10_percent_queue",
        round4(safe_div0(F.col("captured_in_top_10_percent_queue"), F.col("holdout_failures")))
        .alias("capture_rate"),
    )
