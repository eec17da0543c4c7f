"""S10 artifact contract checks: one aggregate row of violation counts per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_contract(df: DataFrame, required: list[str] | None = None, ranges: dict | None = None,
                    min_rows: int | None = None, raise_on_violation: bool = True) -> dict:
    """Check required columns, value ranges ``{col: (lo, hi)}`` (NULL is a violation) and a
    minimum row count, in one aggregate pass. Returns the violation counts."""
    missing = [c for c in (required or []) if c not in df.columns]
    ranges = ranges or {}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c, (lo, hi) in ranges.items():
        bad = F.col(c).isNull()
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        aggs.append(F.sum(bad.cast("int")).alias(c))
    row = df.agg(*aggs).first().asDict()
    report = {"missing_columns": missing, "rows": row.pop("_rows"),
              "range_violations": {k: int(v or 0) for k, v in row.items()}}
    failed = bool(missing) or any(report["range_violations"].values()) or (
        min_rows is not None and report["rows"] < min_rows)
    report["ok"] = not failed
    if failed and raise_on_violation:
        raise AssertionError(f"contract violated: {report}")
    return report


def contract_report(df: DataFrame, ranges: dict, min_rows: int = 0) -> DataFrame:
    """S10 as a lazy one-row frame: row count, per-rule violation counts and ``ok``."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c, (lo, hi) in ranges.items():
        bad = F.col(c).isNull()
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        aggs.append(F.sum(bad.cast("int")).cast("bigint").alias(f"{c}_violations"))
    r = df.agg(*aggs)
    ok = F.col("rows") >= F.lit(min_rows)
    for c in ranges:
        ok = ok & (F.col(f"{c}_violations") == 0)
    return r.withColumn("ok", ok)
