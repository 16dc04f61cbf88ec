"""Scaling of series with kept parameters, their inverse, and series transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import FUZZ_DIGITS
from ..sources.ranges import quantile_rows
from ..sources.series import fill_gaps

METHODS = ("none", "center", "standardize", "minmax", "iqr", "robust", "quantile")
TRANSFORMS = ("none", "log", "sqrt", "scale", "center")
MAD = 1.4826


def handle_missing(series: DataFrame, action: str = "omit") -> DataFrame:
    """``omit`` leaves nulls as they are; ``interpolate``, ``mean`` and ``median`` fill them."""
    if action == "omit":
        return series
    if action == "interpolate":
        return fill_gaps(series)
    if action not in ("mean", "median"):
        raise ValueError(f"unknown action {action}")
    fill = F.avg("value") if action == "mean" else F.percentile("value", 0.5)
    stats = series.groupBy("series_id").agg(fill.alias("_fill"))
    return series.join(stats, "series_id").withColumn("value", F.coalesce("value", "_fill")).select(*series.columns)


def scaling_parameters(series: DataFrame, method: str = "standardize", quantile_range: tuple[float, float] = (0.05, 0.95), robust_center: bool = False, center_value: float | None = None, long: bool = False) -> DataFrame:
    """(series_id, center, scale, divisor) and the original statistics of every series.

    ``scale`` is what is stored for the inverse; ``divisor`` what values are divided by:
    1 where a spread is zero (robust scaling first tries the interquartile range).  With
    ``long`` no task holds a series' values.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    lo, hi = quantile_range
    stats = series.groupBy("series_id").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantile_rows(series, "value", [0.25, 0.5, 0.75, lo, hi], long).withColumn("q", F.transform("q", lambda v: F.round(v, FUZZ_DIGITS)))
    stats = stats.join(q, "series_id", "left")
    stats = stats.select("series_id", "mean", F.col("q")[1].alias("median"), "sd", "min", "max", (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), F.col("q")[3].alias("q_low"), F.col("q")[4].alias("q_high"))
    if method == "robust":
        away = series.join(stats.select("series_id", "median"), "series_id").withColumn("_away", F.abs(F.col("value") - F.col("median")))
        away = quantile_rows(away, "_away", [0.5], long).select("series_id", (MAD * F.col("q")[0]).alias("mad"))
        stats = stats.join(away, "series_id", "left")
    middle = F.col("median") if robust_center else F.col("mean")
    keep = lambda spread: F.when(spread == 0, 1.0).otherwise(spread)
    if method == "none":
        center, scale = F.lit(0.0), F.lit(1.0)
    elif method == "center":
        center, scale = (middle if center_value is None else F.lit(float(center_value))), F.lit(1.0)
    elif method == "standardize":
        center, scale = middle, keep(F.col("iqr") if robust_center else F.col("sd"))
    elif method == "minmax":
        center, scale = F.col("min"), F.col("max") - F.col("min")
    elif method == "iqr":
        center, scale = F.col("median"), keep(F.col("iqr"))
    elif method == "robust":
        center, scale = F.col("median"), F.when(F.col("mad") > 0, F.col("mad")).otherwise(keep(F.col("iqr")))
    else:
        center, scale = F.col("q_low"), F.col("q_high") - F.col("q_low")
    return stats.withColumns({"center": center, "scale": scale}).withColumn("divisor", keep(F.col("scale"))).withColumn("method", F.lit(method))


def apply_scaling(series: DataFrame, method: str = "standardize", parameters: DataFrame | None = None, na_action: str = "omit", **options) -> DataFrame:
    """``series`` with ``scaled``; parameters are fitted to each series unless given."""
    series = handle_missing(series, na_action)
    parameters = scaling_parameters(series, method, **options) if parameters is None else parameters
    joined = series.join(parameters.select("series_id", "center", "divisor"), "series_id")
    return joined.withColumn("scaled", (F.col("value") - F.col("center")) / F.col("divisor")).select(*series.columns, "scaled")


def reverse_scaling(scaled: DataFrame, parameters: DataFrame, column: str = "scaled", into: str = "value") -> DataFrame:
    """Values from scaled ones: times the stored scale, plus the center."""
    out = scaled.join(parameters.select("series_id", F.col("center").alias("_c"), F.col("scale").alias("_s")), "series_id")
    return out.withColumn(into, F.col(column) * F.col("_s") + F.col("_c")).drop("_c", "_s")


def scale_columns(df: DataFrame, columns: list[str], method: str = "standardize", **options) -> tuple[DataFrame, DataFrame]:
    """A frame with its columns scaled, and their parameters (series_id is the column's name)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("series_id"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    parameters = scaling_parameters(long, method, **options)
    wide = parameters.groupBy().pivot("series_id", columns).agg(F.first("center").alias("c"), F.first("divisor").alias("d"))
    joined = df.crossJoin(F.broadcast(wide))  # one row
    scaled = joined.withColumns({c: (F.col(c) - F.col(f"`{c}_c`")) / F.col(f"`{c}_d`") for c in columns})
    return scaled.select(*df.columns), parameters


def reverse_columns(df: DataFrame, parameters: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of ``scale_columns``."""
    wide = parameters.groupBy().pivot("series_id", columns).agg(F.first("center").alias("c"), F.first("scale").alias("s"))
    joined = df.crossJoin(F.broadcast(wide))  # one row
    return joined.withColumns({c: F.col(c) * F.col(f"`{c}_s`") + F.col(f"`{c}_c`") for c in columns}).select(*df.columns)


def detect_scaling(series: DataFrame, prefer_robust: bool = True) -> DataFrame:
    """(series_id, outlier_share, skew_index, method): which scaling suits each series."""
    stats = scaling_parameters(series, "none")
    lo, hi = F.col("q25") - 1.5 * F.col("iqr"), F.col("q75") + 1.5 * F.col("iqr")
    share = series.join(stats, "series_id").groupBy("series_id").agg(F.avg(((F.col("value") < lo) | (F.col("value") > hi)).cast("double")).alias("outlier_share"))
    out = stats.join(share, "series_id").withColumn("skew_index", F.when(F.col("sd") > 0, F.abs(F.col("mean") - F.col("median")) / F.col("sd")))
    method = (
        F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, "none")
        .when(F.lit(prefer_robust) & (F.col("outlier_share") > 0.1), F.when(F.col("skew_index") > 0.5, "quantile").otherwise("iqr"))
        .when(F.lit(prefer_robust) & (F.col("outlier_share") > 0.05), "robust")
        .when((F.col("max") - F.col("min") > 1000) | (F.col("min") >= 0), "minmax")
        .otherwise("standardize")
    )
    return out.select("series_id", "outlier_share", "skew_index", method.alias("method"))


def check_series(series: DataFrame, min_length: int = 10) -> DataFrame:
    """One row a series: length, mean, sd, extremes, nulls, range, and whether it is long enough."""
    out = series.groupBy("series_id").agg(
        F.count("*").alias("length"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.sum(F.col("value").isNull().cast("long")).alias("na_count"),
    )
    return out.withColumn("range", F.col("max") - F.col("min")).withColumn("long_enough", F.col("length") >= min_length)


def transform_parameters(series: DataFrame, method: str) -> DataFrame:
    """(series_id, shift, center, scale) of a transform."""
    if method not in TRANSFORMS:
        raise ValueError(f"unknown transform {method}")
    least = F.min("value")
    shift = {"log": F.when(least <= 0, F.abs(least) + 1).otherwise(0.0), "sqrt": F.when(least < 0, F.abs(least)).otherwise(0.0)}.get(method, F.lit(0.0))
    center = F.avg("value") if method in ("scale", "center") else F.lit(0.0)
    scale = F.stddev_samp("value") if method == "scale" else F.lit(1.0)
    return series.groupBy("series_id").agg(shift.alias("shift"), center.alias("center"), scale.alias("scale"))


def transform_series(series: DataFrame, method: str = "none") -> tuple[DataFrame, DataFrame]:
    """The transformed series (``value`` replaced) and its parameters."""
    p = transform_parameters(series, method)
    x = F.col("value") + F.col("shift")
    new = {"log": F.log(x), "sqrt": F.sqrt(x)}.get(method, (F.col("value") - F.col("center")) / F.col("scale"))
    return series.join(p, "series_id").withColumn("value", new).select(*series.columns), p


def reverse_transform(series: DataFrame, parameters: DataFrame, method: str) -> DataFrame:
    """The exact inverse of ``transform_series``."""
    back = {"log": F.exp("value") - F.col("shift"), "sqrt": F.pow("value", 2) - F.col("shift")}.get(method, F.col("value") * F.col("scale") + F.col("center"))
    return series.join(parameters, "series_id").withColumn("value", back).select(*series.columns)


def window_size(series: DataFrame, max_windows: int = 20, least: int = 5) -> DataFrame:
    """A window length for each series: about ``max_windows`` windows, a third of the series at most."""
    n = F.count("*")
    size = F.least(F.greatest(F.floor(n / max_windows), F.lit(least)), F.floor(n / 3)).cast("long")
    sized = series.groupBy("series_id").agg(n.alias("n"), size.alias("window_size"))
    return sized.withColumn("resulting_windows", F.when(F.col("window_size") > 0, F.floor((F.col("n") - F.col("window_size")) / F.col("window_size")) + 1))
