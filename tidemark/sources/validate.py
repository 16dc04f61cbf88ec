"""Checks of frames and arguments, raised before anything runs, and of values, as a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def check_frame(df: DataFrame, columns: list[str], numeric: list[str] = ()) -> None:
    """Raises unless all columns are there and the numeric ones are numbers."""
    missing = [c for c in (*columns, *numeric) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in df.schema}
    wrong = [c for c in numeric if not isinstance(kinds[c], NumericType)]
    if wrong:
        raise ValueError(f"not numeric: {', '.join(wrong)}")


def check_states(df: DataFrame, id_column: str, value_column: str, n_states: int) -> None:
    """Raises unless a frame can be made into a state network."""
    check_frame(df, [id_column], [value_column])
    if n_states < 2:
        raise ValueError("at least two states")


def check_windows(n: int, size: int, step: int = 1) -> None:
    """Raises unless windows of ``size`` rows, ``step`` apart, fit ``n`` rows."""
    if size < 2 or step < 1:
        raise ValueError("a window has two rows or more, a step one")
    if size > n:
        raise ValueError(f"windows of {size} rows do not fit {n}")


def check_choice(name: str, known: tuple[str, ...] | list[str], what: str = "method") -> None:
    """Raises unless a name is known."""
    if name not in known:
        raise ValueError(f"unknown {what} {name}; known: {', '.join(sorted(known))}")


def series_report(series: DataFrame, least: int = 2) -> DataFrame:
    """(series_id, n, n_missing, n_infinite, constant, usable): a row a series; usable ones have ``least`` finite values, not all equal."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    out = series.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("n_missing"), F.count_if(F.abs(v) == float("inf")).alias("n_infinite"),
        F.count_if(finite).alias("_k"), (F.min(F.when(finite, v)) == F.max(F.when(finite, v))).alias("constant"),
    )
    constant = F.coalesce("constant", F.lit(True))
    return out.select("series_id", "n", "n_missing", "n_infinite", constant.alias("constant"), ((F.col("_k") >= least) & ~constant).alias("usable"))
