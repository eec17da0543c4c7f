"""Null-safe column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline.functions import constants as C

__all__ = [
    "safe_div", "safe_div0", "clip_lower", "clip_upper", "psi_verdict", "risk_band", "shift_id",
    "operator_name", "heuristic_rul", "failure_label", "flags_to_labels", "decision", "round4",
    "gauge_band", "kelvin_to_celsius", "energy_cost_per_hour", "percent_label", "thousands_label", "after_first_separator",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """``num / den`` that is NULL when ``den`` is 0 (SQL ``NULLIF``)."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def safe_div0(num, den) -> Column:
    """``num / den`` that is 0.0 when ``den`` is 0 (the Python-side guard)."""
    return F.coalesce(safe_div(num, den).cast("double"), F.lit(0.0))


def clip_lower(x, floor: float) -> Column:
    """Lower clip that keeps NULL as NULL (``greatest`` would drop it)."""
    x = _c(x)
    return F.when(x < F.lit(floor), F.lit(floor)).otherwise(x)


def clip_upper(x, cap: float) -> Column:
    x = _c(x)
    return F.when(x > F.lit(cap), F.lit(cap)).otherwise(x)


def round4(x) -> Column:
    return F.round(_c(x), 4)


def decision(p, threshold: float = C.DECISION_THRESHOLD) -> Column:
    return (_c(p) >= F.lit(threshold)).cast("int")


def psi_verdict(psi) -> Column:
    psi = _c(psi)
    return (F.when(psi >= C.PSI_SIGNIFICANT_THRESHOLD, C.VERDICT_SIGNIFICANT)
            .when(psi >= C.PSI_MODERATE_THRESHOLD, C.VERDICT_MODERATE)
            .otherwise(C.VERDICT_NONE))


def risk_band(risk) -> Column:
    pct = _c(risk) * 100.0
    expr = None
    for upper, label in C.RISK_BANDS:
        expr = F.when(pct < upper, label) if expr is None else expr.when(pct < upper, label)
    return expr.otherwise(C.RISK_BAND_TOP)


def gauge_band(x, bands: tuple[float, float], low: str, mid: str = "warning", high: str = "danger") -> Column:
    x = _c(x)
    return F.when(x > bands[1], high).when(x > bands[0], mid).otherwise(low)


def shift_id(ts) -> Column:
    h = F.hour(_c(ts))
    return F.when((h >= C.SHIFT_START_HOUR) & (h < C.SHIFT_END_HOUR), C.SHIFT_DAY).otherwise(C.SHIFT_NIGHT)


def operator_name(ts) -> Column:
    h = F.hour(_c(ts))
    return F.when((h >= C.SHIFT_START_HOUR) & (h < C.SHIFT_END_HOUR), C.OPERATOR_DAY).otherwise(C.OPERATOR_NIGHT)


def heuristic_rul(risk) -> Column:
    """max(1, round_half_even(48 * (1 - risk))) as bigint."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(C.MAX_RUL_HOURS)) * (1.0 - _c(risk)), 0).cast("bigint"))


def failure_label(code) -> Column:
    """Code -> label through a literal map (5 fixed entries)."""
    pairs = []
    for k in C.FAILURE_CODES:
        pairs += [F.lit(k), F.lit(C.FAILURE_LABELS[k])]
    return F.create_map(*pairs)[_c(code)]


def flags_to_labels(cols: dict[str, str] | None = None) -> Column:
    """Multi-hot flag columns -> array of labels in fixed column order."""
    cols = cols or {c: c.lower() for c in C.FAILURE_CODES}
    return F.array_compact(F.array(*[
        F.when(F.col(col) == 1, F.lit(C.FAILURE_LABELS[code])) for code, col in cols.items()
    ]))


def kelvin_to_celsius(x) -> Column:
    return _c(x) - C.KELVIN_OFFSET


def energy_cost_per_hour(current, voltage) -> Column:
    return _c(current) * _c(voltage) * C.ENERGY_TARIFF / 1000.0


def percent_label(x, decimals: int = 1):
    """a share as a percent string, e.g. 0.7773 -> '77.7%'."""
    return F.concat(F.format_number(_c(x) * 100.0, decimals), F.lit("%"))


def thousands_label(x):
    """an amount with thousands separators, e.g. 238000 -> '238,000'."""
    return F.format_number(_c(x).cast("double"), 0)


def after_first_separator(x, sep: str = "__"):
    """the text after the first ``sep``; the whole text when ``sep`` is absent."""
    return F.element_at(F.split(_c(x), sep, 2), -1)
