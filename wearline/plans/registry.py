"""Registry: query name -> Spark builder ``(spark, sf_dir) -> DataFrame`` and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def register(name: str, oracle: str | None = None, ids: str = ""):
    """Register a Spark builder; ``oracle`` is DuckDB SQL over the driver's tables."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        OPERATORS[name] = ids
        return fn
    return deco
