"""Early-warning signals on a series of exponents: ten indicators, a weighted score, graded levels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .markov import run_lengths

# The indicators' weights.
WEIGHTS = {
    "extreme_low": 2.0, "extreme_high": 2.0, "trend_up": 1.5, "trend_down": 1.5, "high_volatility": 1.5, "flickering": 2.0,
    "variance_ratio": 1.0, "spectral_shift": 1.0, "autocorr_increase": 1.5, "state_persistence": 1.0,
}
LEVELS = ("none", "low", "moderate", "high", "critical")


def _rows_of(lists: pd.Series, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of exactly ``n`` values as a matrix, and their places."""
    at = np.flatnonzero([v is not None and len(v) == n for v in lists])
    return np.array([np.asarray(lists.iloc[i], float) for i in at]).reshape(len(at), n), at


@F.pandas_udf(BooleanType())
def _long_period(last: pd.Series) -> pd.Series:
    """Whether the periodogram of a list of 100 values peaks beyond a period of 20; null for other lists.

    The values' line is removed and a tenth of each end tapered first.
    """
    n = 100
    x, at = _rows_of(last, n)
    place, edge = np.arange(n) - (n - 1) / 2, np.minimum(np.arange(n), np.arange(n)[::-1])
    taper = np.where(edge < n // 10, 0.5 * (1 - np.cos(math.pi * (2 * edge + 1) / (2 * (n // 10)))), 1.0)
    slope = x @ place / (place @ place)
    power = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True) - slope[:, None] * place) * taper, axis=1)[:, 1:]) ** 2
    out = pd.Series([None] * len(last), dtype="object")
    out.iloc[at] = n / (1 + power.argmax(axis=1)) > 20
    return out


@F.pandas_udf(BooleanType())
def _memory_grown(last: pd.Series) -> pd.Series:
    """Whether the mean autocorrelation at lags 1 to 5 of the last 50 values exceeds that of the 50 before by 0.2; null if unknown."""
    x, at = _rows_of(last, 100)

    def memory(part: np.ndarray) -> np.ndarray:
        d = part - part.mean(axis=1, keepdims=True)
        bottom = (d * d).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(bottom > 0, sum((d[:, k:] * d[:, :-k]).sum(axis=1) for k in range(1, 6)) / bottom / 5, np.nan)

    new, old = memory(x[:, 50:]), memory(x[:, :50])
    known = ~np.isnan(new) & ~np.isnan(old)
    out = pd.Series([None] * len(last), dtype="object")
    out.iloc[at[known]] = (new > old + 0.2)[known]
    return out


def indicators(rows: DataFrame, extremes: tuple[float, float] = (0.05, 0.95), trend_q: float = 0.9, volatility_q: float = 0.9, trend: int = 30, volatility: int = 30, flicker: int = 20, full: bool = False) -> DataFrame:
    """``rows`` (series_id, t, value, state) with one 0/1 column an indicator; high_volatility is null before its first full frame.

    The basic set leaves the last four at 0; ``full`` computes them too.
    """
    whole = Window.partitionBy("series_id")
    by = whole.orderBy("t")
    frame = lambda n: by.rowsBetween(-(n - 1), 0)
    i = F.row_number().over(by)
    out = rows.withColumns({
        "_i": i, "_x": F.col("t").cast("double"), "_q": F.percentile("value", F.array(F.lit(extremes[0]), F.lit(extremes[1]))).over(whole),
        "_mean": F.avg("value").over(whole), "_old": F.lag("state").over(by),
    })
    out = out.withColumns({
        "_away": F.percentile(F.abs(F.col("value") - F.col("_mean")), F.lit(trend_q)).over(whole),
        "_slope": F.covar_samp("value", "_x").over(frame(trend)) / F.var_samp("_x").over(frame(trend)),
        "_yy": F.var_samp("value").over(frame(trend)) * (trend - 1), "_xx": F.var_samp("_x").over(frame(trend)) * (trend - 1),
        "_vol": F.when(i >= volatility, F.stddev_pop("value").over(frame(volatility))),
        "_moved": F.when(F.col("_old").isNotNull() & (F.col("state") != F.col("_old")), 1).otherwise(0),
        "_kinds": F.size(F.collect_set("state").over(frame(flicker))),
    })
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("_yy") - F.col("_slope") * F.col("_slope") * F.col("_xx")) / (trend - 2) / F.col("_xx"))
    clear = (F.col("_i") >= trend) & (F.abs("_slope") > 2 * se) & (se > 0)
    out = out.withColumns({
        "_volq": F.percentile("_vol", F.lit(volatility_q)).over(whole),
        "_moves": F.sum("_moved").over(frame(flicker - 1)),
    })
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    made = {
        "extreme_low": yes(F.col("value") < F.col("_q")[0]), "extreme_high": yes(F.col("value") > F.col("_q")[1]),
        "trend_up": yes(clear & (F.col("_slope") > F.col("_away") / trend)), "trend_down": yes(clear & (F.col("_slope") < -F.col("_away") / trend)),
        "high_volatility": (F.col("_vol") > F.col("_volq")).cast("int"),
        "flickering": yes((F.col("_i") >= flicker) & ((F.col("_moves") > flicker * 0.2) | (F.col("_kinds") >= 3))),
        "variance_ratio": F.lit(0), "spectral_shift": F.lit(0), "autocorr_increase": F.lit(0), "state_persistence": F.lit(0),
    }
    if full:
        step = lambda k: F.col("value") - F.lag("value", k).over(by)
        out = out.withColumns({f"_d{k}": step(k) for k in (1, 2, 4)})
        out = out.withColumns({f"_v{k}": F.var_samp(f"_d{k}").over(frame(60 - k)) / k for k in (1, 2, 4)})
        off = lambda k: F.abs(F.try_divide(F.col(f"_v{k}"), F.col("_v1")) - 1) > 0.5
        out = out.withColumns({"_last": F.collect_list("value").over(frame(100)), "_new": F.col("_moved") + F.when(F.col("_old").isNull(), 1).otherwise(0)})
        out = out.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("_len", F.count("*").over(Window.partitionBy("series_id", "_run")))
        runs = out.groupBy("series_id", "_run").agg(F.first("_len").alias("l")).groupBy("series_id").agg(F.percentile("l", 0.9).alias("_lenq"))
        out = out.join(runs, "series_id").withColumns({"_long": _long_period("_last"), "_grown": _memory_grown("_last")})
        made |= {
            "variance_ratio": yes((F.col("_i") >= 60) & (F.col("_v1") > 0) & (off(2) | off(4))),
            "spectral_shift": yes(F.col("_long")),
            "autocorr_increase": yes(F.col("_grown")),
            "state_persistence": yes(F.col("_len") > F.col("_lenq")),
        }
    return out.withColumns(made).select(*rows.columns, *WEIGHTS)


def warning_levels(flags: DataFrame, boost: bool = False) -> DataFrame:
    """``flags`` with score, level (0 to 4 by the 40, 60 and 80 % quantiles of positive scores) and confidence.

    With ``boost`` an inner row's score grows by the share of positive scores within 10
    rows; unknown indicators make scores unknown.
    """
    whole = Window.partitionBy("series_id")
    raw = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    out = flags.withColumn("score", raw)
    if boost:
        by = whole.orderBy("t")
        near = by.rowsBetween(-10, 10)
        out = out.withColumns({"_i": F.row_number().over(by), "_n": F.count("*").over(whole), "_share": F.avg((F.col("score") > 0).cast("double")).over(near), "_known": F.count("score").over(near)})
        lifted = F.when(F.col("_known") == 21, F.col("score") * (1 + F.col("_share")))
        out = out.withColumn("score", F.when((F.col("_i") > 10) & (F.col("_i") <= F.col("_n") - 10), lifted).otherwise(F.col("score"))).drop("_i", "_n", "_share", "_known")
    q = F.percentile(F.when(F.col("score") > 0, F.col("score")), F.array(F.lit(0.4), F.lit(0.6), F.lit(0.8))).over(whole)
    out = out.withColumns({"_q": q, "_max": F.max("score").over(whole)})
    s, at = F.col("score"), lambda k: F.col("_q")[k] + 1e-12
    level = F.when(s.isNull() | (s <= 0), 0).when(s <= at(0), 1).when(s <= at(1), 2).when(s <= at(2), 3).otherwise(4)
    return out.withColumns({"level": level, "confidence": F.when(F.col("_max") > 0, 100 * s / F.col("_max"))}).drop("_q", "_max")


def detect_warnings(rows: DataFrame, full: bool = False, **options) -> DataFrame:
    """Indicators, score, level and confidence; the full variant computes all ten and boosts."""
    return warning_levels(indicators(rows, full=full, **options), boost=full)


def warning_summary(levels: DataFrame) -> DataFrame:
    """(series_id, level, n, share) of every level that occurs."""
    counts = levels.groupBy("series_id", "level").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id")))


def recent_trend(levels: DataFrame, rows: int = 20) -> DataFrame:
    """(series_id, current, recent, previous, trend): mean level of the last ``rows`` rows against those before."""
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("t")))
    d = levels.withColumn("_b", back).where(F.col("_b") <= 2 * rows)
    out = d.groupBy("series_id").agg(F.max(F.when(F.col("_b") == 1, F.col("level"))).alias("current"), F.avg(F.when(F.col("_b") <= rows, F.col("level"))).alias("recent"), F.avg(F.when(F.col("_b") > rows, F.col("level"))).alias("previous"))
    trend = F.when(F.col("recent") > F.col("previous"), "increasing").when(F.col("recent") < F.col("previous"), "decreasing").otherwise("stable")
    return out.withColumn("trend", trend)


def level_islands(levels: DataFrame) -> DataFrame:
    """Runs of equal warning levels: (series_id, run, level, start, end, duration)."""
    return run_lengths(levels.select("series_id", "t", F.col("level").alias("state"))).withColumnRenamed("state", "level")
