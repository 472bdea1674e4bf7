"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .inputs import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: list[str] | None = None):
    """Register ``fn(inputs)`` under ``name`` with its checking SQL, if any."""

    def register(fn: Callable[[Inputs], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Inputs(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views or [], sql)
        return run

    return register


# White space spelled out, for engines without the named classes.
SQL_SPACE = r"\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SQL_WS, SQL_NON_WS = f"[{SQL_SPACE}]", f"[^{SQL_SPACE}]"
SQL_WS_INLINE = "[" + SQL_SPACE.replace(r"\n", "") + "]"


def rounded(expr: str, digits: int) -> str:
    """SQL rounding half up on the decimal form, as the operators round."""
    text = f"CAST(CAST({expr} AS DOUBLE) AS VARCHAR)"
    return f"CAST(round(CAST({text} AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"
