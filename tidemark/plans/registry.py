"""Queries by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import series as src

NUDGE = 1.3e-11

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SERIES = {"s1": src.events_by_user, "s2": src.orders_daily, "s3": src.ships_daily, "s4": src.events_hourly, "s5": src.events_by_user_and_type, "s6": src.events_in_time}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query under a name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def on_series(name: str, which: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Registers a query over one of the canonical series; ``{s}`` in its SQL is the series' definition."""
    query(name, None if sql is None else sql.replace("{s}", src.SQL[which]))(lambda spark, sf_dir: build(SERIES[which](spark, sf_dir)))


def r6(c: str | Column, alias: str | None = None, digits: int = 9) -> Column:
    """A double rounded for comparison.

    Engines differ on exact halves (short binary fractions have many), so all values are
    moved off them by a little first; adding zero turns -0.0 into 0.0.
    """
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)
    return out.alias(alias or c) if alias or isinstance(c, str) else out


def r6_of_many(c: str, digits: int = 9) -> Column:
    """``r6`` for very many rows: numbers from zero up are rounded as DuckDB does, without decimals of any length."""
    at = (F.col(c) + F.lit(NUDGE)) * float(10**digits)
    whole = F.floor(at)
    near = (whole + F.when(at - whole >= 0.5, 1).otherwise(0)) / float(10**digits)
    return F.when((at >= 0) & (at < 1e15), near).otherwise(r6(c, digits=digits)).alias(c)


def q6(expression: str, alias: str, digits: int = 9) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {alias}"
