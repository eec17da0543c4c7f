"""wearline: predictive-maintenance analytics as Spark DataFrame operators.

Every operator is a function ``op(df, ..., **params) -> DataFrame`` that stays
lazy; the few that need a bounded driver-side step (bucket boundaries, data
dependent column lists) say so in their docstring.
"""

__version__ = "0.1.0"
