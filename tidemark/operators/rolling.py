"""Right-aligned rolling measures over full row windows, all from one sort of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranges import scope

MEASURES = ("complexity", "fluctuation", "distribution", "autocorrelation", "max", "min", "variance")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _steps(a: Column) -> Column:
    """Differences of neighbours of an array with two or more elements."""
    return F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda y, x: y - x)


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def fluctuation(x: Column, lo: Column, hi: Column) -> Column:
    """Root mean square of successive differences over the scale's range, within 0..1."""
    rms = F.sqrt(_sum(F.transform(_steps(x), lambda d: d * d)) / (F.size(x) - 1))
    return F.when((F.size(x) >= 2) & (lo < hi), _clamp(rms / (hi - lo)))


def distribution(x: Column, lo: Column, hi: Column) -> Column:
    """One minus the mean shortfall of the sorted values' gaps against an even spread over the scale."""
    even = (hi - lo) / (F.size(x) - 1)
    short = F.transform(_steps(F.array_sort(x)), lambda g: F.greatest(even - g, F.lit(0.0)) / even)
    return F.when((F.size(x) >= 2) & (lo < hi), _clamp(1 - _sum(short) / (F.size(x) - 1)))


def autocorrelation(x: Column) -> Column:
    """Lag-one autocorrelation; null with fewer than two distinct values."""
    mean = _sum(x) / F.size(x)
    left, right = F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1)
    top = _sum(F.zip_with(left, right, lambda a, b: (a - mean) * (b - mean)))
    bottom = _sum(F.transform(x, lambda a: (a - mean) * (a - mean)))
    return F.when(F.size(F.array_distinct(x)) >= 2, top / bottom)


def rolling_measures(
    df: DataFrame,
    columns: list[str] | None = None,
    measures: tuple[str, ...] = MEASURES,
    width: int = 7,
    series_id: str = "series_id",
    order: str = "t",
    scale: tuple[float, float] | None = None,
    rescale: bool = False,
    block: int | None = None,
) -> DataFrame:
    """``df`` with ``<column>_<measure>`` for every column and measure.

    Frames hold the row and the ``width - 1`` before it and are full: earlier rows get
    null.  Nulls inside a frame are skipped.  The scale is the range of all columns in
    the series unless given; equal bounds give null.  With ``rescale`` each result is
    stretched to the scale within its series (a flat one to the midpoint).  With
    several columns ``mean_<measure>`` and ``median_<measure>`` follow.  ``block`` cuts
    series of canonical names into ranges of so many rows, so that no task holds a series.
    """
    if width < 2 or width != int(width):
        raise ValueError("width is a whole number of 2 or more")
    if unknown := set(measures) - set(MEASURES):
        raise ValueError(f"unknown measures: {sorted(unknown)}")
    if scale is not None and not scale[0] < scale[1]:
        raise ValueError("the scale's minimum is below its maximum")
    if block is not None and (series_id, order) != ("series_id", "t"):
        raise ValueError("ranges are cut by series_id and t")
    columns, given = columns or ["value"], df.columns
    within = scope(block)
    keys = within.part if block is not None else [series_id]
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    if block is None:
        df = df.withColumn("_i", F.row_number().over(Window.partitionBy(series_id).orderBy(order)))
    else:
        df = within.rows(df, width - 1)
    if scale:
        lo, hi = F.lit(float(scale[0])), F.lit(float(scale[1]))
    else:
        least = F.least(*columns) if len(columns) > 1 else F.col(columns[0])
        most = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
        df = within.totals(df, {"_lo": F.min(least), "_hi": F.max(most)}, [series_id])
        lo, hi = F.col("_lo"), F.col("_hi")
    df = df.withColumn("_full", F.col("_i") >= width)
    df = df.withColumns({f"_x{i}": F.collect_list(c).over(frame) for i, c in enumerate(columns)})
    # What window aggregates can do needs no list, and what the complexity is made of is computed once.
    plain = {"variance": F.var_samp, "max": F.max, "min": F.min}
    df = df.withColumns({f"_{m}{i}": plain[m](c).over(frame) for m in plain if m in measures for i, c in enumerate(columns)})
    parts = {"fluctuation": fluctuation, "distribution": distribution}
    df = df.withColumns({f"_{m}{i}": F.when(F.col("_full"), parts[m](F.col(f"_x{i}"), lo, hi)) for m in parts if {m, "complexity"} & set(measures) for i in range(len(columns))})
    made: dict[str, Column] = {}
    for i, c in enumerate(columns):
        x = F.col(f"_x{i}")
        kinds = {
            "complexity": lambda i=i: F.col(f"_fluctuation{i}") * F.col(f"_distribution{i}"),
            "autocorrelation": lambda x=x: autocorrelation(x),
            **{m: lambda m=m, i=i: F.col(f"_{m}{i}") for m in (*plain, *parts)},
        }
        made |= {f"{c}_{m}": F.when(F.col("_full"), kinds[m]()) for m in measures}
    out = df.withColumns(made)
    if rescale:
        out = within.own(out)
        out = within.totals(out, {f"_a{k}": F.min(k) for k in made} | {f"_b{k}": F.max(k) for k in made}, [series_id])
        out = out.withColumns({
            k: F.when(F.col(k).isNotNull(), F.when(F.col(f"_b{k}") - F.col(f"_a{k}") < 1.5e-8, (lo + hi) / 2).otherwise(
                (F.col(k) - F.col(f"_a{k}")) / (F.col(f"_b{k}") - F.col(f"_a{k}")) * (hi - lo) + lo))
            for k in made
        })
    elif block is not None:
        out = out.where("_block = _own")
    if len(columns) > 1:
        across: dict[str, Column] = {}
        for m in measures:
            known = F.array_sort(F.array_compact(F.array(*[F.col(f"{c}_{m}") for c in columns])))
            n = F.size(known)
            across[f"mean_{m}"] = F.when(n > 0, _sum(known) / n)
            middle = (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2
            across[f"median_{m}"] = F.when(n > 0, middle)
        out = out.withColumns(across)
        made |= across
    return out.select(*given, *made)
