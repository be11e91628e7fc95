"""Registry of named queries and their independent SQL oracles.

``@register(name, sql=...)`` records a ``(spark, sf_dir) -> DataFrame``
builder and, when the operator is expressible in plain SQL, an equivalent
DuckDB query over the same Parquet tables. Output columns carry the same
names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPERATOR_IDS: dict[str, str] = {}


def register(name: str, sql: str | None = None, op: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        OPERATOR_IDS[name] = op
        return fn
    return deco


def masked(expr: str = "text") -> str:
    """Oracle helper: RE2 word boundaries are ASCII, so every non-ASCII
    character (all letters in the test prose) becomes 'x' first."""
    return f"regexp_replace({expr}, '[^\\x00-\\x7F]', 'x', 'g')"
