"""Hurst exponents: detrended fluctuation, rescaled range, multifractal; global or in rolling windows.

A window's rows are numbered i = 1..n; its profile is the running sum of deviations from
its mean.  Every scale cuts it into segments from the front and from the back; detrending
a segment is one grouped regression (``regr_*``).  Rolling windows are lists, analysed as
matrices in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.series import fill_gaps
from .markov import run_lengths
from .scaling import apply_scaling

METHODS = ("dfa", "rs", "mfdfa")
# Upper bounds of the categories of an exponent, and their names.
CATEGORIES = [(0.4, "strong_antipersistent"), (0.5, "antipersistent"), (0.6, "random_walk"), (0.7, "persistent"), (None, "strong_persistent")]
WIDTHS = [(0.1, "monofractal"), (0.3, "weak_multifractal"), (0.5, "moderate_multifractal"), (None, "strong_multifractal")]


def whole_series(series: DataFrame) -> DataFrame:
    """(series_id, win, i, n, x): every series as one window; nulls are left out."""
    known = series.where("value IS NOT NULL")
    i = F.row_number().over(Window.partitionBy("series_id").orderBy("t"))
    return known.select("series_id", F.lit(0).cast("long").alias("win"), i.cast("long").alias("i"), F.count("*").over(Window.partitionBy("series_id")).alias("n"), F.col("value").alias("x"))


def rolling_windows(series: DataFrame, window: int = 50, step: int = 1) -> DataFrame:
    """Windows centred on t (win): rows t - h to t + h - 1 with h = window // 2, for t = h + 1, h + 1 + step, ... to N - h.

    The last row of a series enters no window.
    """
    if window < 8:
        raise ValueError("a window has 8 rows or more")
    h = window // 2
    sized = series.withColumn("_n", F.count("*").over(Window.partitionBy("series_id")))
    lo, hi = F.greatest(F.lit(h + 1), F.col("t") - h + 1), F.least(F.col("_n") - h, F.col("t") + h)
    first = lo + F.pmod(F.lit(h + 1) - lo, F.lit(step))
    placed = sized.withColumn("win", F.explode(F.when(first <= hi, F.sequence(first, hi, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    out = placed.select("series_id", "win", (F.col("t") - F.col("win") + h + 1).alias("i"), F.lit(2 * h).cast("long").alias("n"), F.col("value").alias("x"))
    bad = F.max(F.col("x").isNull().cast("int")).over(Window.partitionBy("series_id", "win"))
    return out.withColumn("_bad", bad).where("_bad = 0").drop("_bad")


def scale_grid(n: Column, least: int = 4, most: int | None = None, count: int = 10) -> Column:
    """Distinct log-spaced whole scales from ``least`` (4 at least) to ``most`` (n // 4; a larger one than n / 2 counts as that)."""
    least = max(4, least)
    top = F.floor(n / 4) if most is None else F.when(F.lit(most) > n / 2, F.floor(n / 4)).otherwise(F.lit(most))
    at = lambda k: F.bround(F.exp(F.log(F.lit(float(least))) + (F.log(top.cast("double")) - F.log(F.lit(float(least)))) * k / (count - 1)), 0).cast("long")
    grid = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at))
    return F.when(top > least, F.filter(grid, lambda s: (s >= least) & (s <= top))).otherwise(F.array().cast("array<bigint>"))


def _scaled(rows: DataFrame, grid: Column) -> DataFrame:
    by = Window.partitionBy("series_id", "win")
    mean = F.avg("x").over(by)
    rows = rows.withColumn("_d", F.col("x") - mean).withColumn("p", F.sum("_d").over(by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("s", F.explode(grid)).where(F.floor(F.col("n") / F.col("s")) >= 1)


def segment_residuals(rows: DataFrame, grid: Column) -> DataFrame:
    """(series_id, win, s, back, seg, f2): mean squared residuals of each segment's line fit."""
    rows = _scaled(rows, grid).where(F.floor(F.col("n") / F.col("s")) >= 2)
    front = F.floor((F.col("i") - 1) / F.col("s"))
    rear = F.floor((F.col("n") - F.col("i")) / F.col("s"))
    both = rows.select("series_id", "win", "n", "i", "p", "s", F.explode(F.array(F.struct(F.lit(0).alias("back"), front.alias("seg")), F.struct(F.lit(1).alias("back"), rear.alias("seg")))).alias("g"))
    both = both.select("series_id", "win", "n", F.col("i").cast("double").alias("i"), "p", "s", "g.back", "g.seg").where(F.col("seg") < F.floor(F.col("n") / F.col("s")))
    fits = both.groupBy("series_id", "win", "s", "back", "seg").agg(F.expr("regr_syy(p, i)").alias("yy"), F.expr("regr_sxy(p, i)").alias("xy"), F.expr("regr_sxx(p, i)").alias("xx"))
    f2 = (F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")) / F.col("s")
    return fits.select("series_id", "win", "s", "back", "seg", F.greatest(F.lit(0.0), f2).alias("f2"))


def _fit(points: DataFrame, by: list[str]) -> DataFrame:
    logs = points.where("f > 0").select(*by, F.log("s").alias("ls"), F.log("f").alias("lf"))
    fit = logs.groupBy(*by).agg(F.expr("regr_slope(lf, ls)").alias("hurst"), F.expr("regr_r2(lf, ls)").alias("r2"), F.count("*").alias("n_scales"))
    return fit.where("n_scales >= 3")


def dfa(rows: DataFrame, grid: Column | None = None) -> DataFrame:
    """(series_id, win, hurst, r2, n_scales) by detrended fluctuation analysis; three scales at least."""
    f2 = segment_residuals(rows, scale_grid(F.col("n")) if grid is None else grid)
    return _fit(f2.groupBy("series_id", "win", "s").agg(F.sqrt(F.avg("f2")).alias("f")), ["series_id", "win"])


def rescaled_range(rows: DataFrame, grid: Column | None = None) -> DataFrame:
    """(series_id, win, hurst, r2, n_scales) by rescaled range; the exponent is kept within 0..1."""
    rows = _scaled(rows, scale_grid(F.col("n")) if grid is None else grid)
    rows = rows.withColumn("seg", F.floor((F.col("i") - 1) / F.col("s"))).where(F.col("seg") < F.floor(F.col("n") / F.col("s")))
    part = Window.partitionBy("series_id", "win", "s", "seg")
    rows = rows.withColumn("_a", F.col("x") - F.avg("x").over(part))
    rows = rows.withColumn("c", F.sum("_a").over(part.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy("series_id", "win", "s", "seg").agg((F.max("c") - F.min("c")).alias("r"), F.stddev_pop("x").alias("sd"))
    points = blocks.where("sd > 0 AND r > 0").groupBy("series_id", "win", "s").agg(F.avg(F.col("r") / F.col("sd")).alias("f"))
    return _fit(points, ["series_id", "win"]).withColumn("hurst", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("hurst"))))


def _line(points: np.ndarray, scales: np.ndarray) -> pd.DataFrame:
    """Slope, r squared and number of scales of each row's log-log line; nulls below three scales."""
    known = points > 0
    n = known.sum(axis=1)
    x = np.where(known, np.log(scales), 0.0)
    y = np.where(known, np.log(np.where(known, points, 1.0)), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        dx = np.where(known, x - (x.sum(axis=1) / n)[:, None], 0)
        dy = np.where(known, y - (y.sum(axis=1) / n)[:, None], 0)
        xx, xy, yy = (dx * dx).sum(axis=1), (dx * dy).sum(axis=1), (dy * dy).sum(axis=1)
        slope, r2 = xy / xx, np.where(yy > 0, xy * xy / (xx * yy), 1.0)
    fine = n >= 3
    return pd.DataFrame({"hurst": np.where(fine, slope, np.nan), "r2": np.where(fine, r2, np.nan), "n_scales": n.astype(np.int64)})


def _segments(p: np.ndarray, s: int, back: bool) -> np.ndarray:
    """The rows' whole segments of ``s`` places, from the front or the back."""
    k = p.shape[1] // s
    return (p[:, p.shape[1] - k * s :] if back else p[:, : k * s]).reshape(len(p), k, s)


def residuals(p: np.ndarray, s: int) -> np.ndarray:
    """Mean squared residuals of the line fits of each row's segments, from the front and from the back."""
    seg = np.concatenate([_segments(p, s, back) for back in (False, True)], axis=1)
    i = np.arange(s) - (s - 1) / 2
    d = seg - seg.mean(axis=2, keepdims=True)
    return np.maximum(0, ((d * d).sum(axis=2) - (d @ i) ** 2 / (i @ i)) / s)


def fluctuations(x: np.ndarray, scales: list[int]) -> np.ndarray:
    """Detrended fluctuation of the rows of a matrix at every scale that has two segments; 0 at others."""
    p, out = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1), np.zeros((len(x), len(scales)))
    for k, s in enumerate(scales):
        if x.shape[1] // s >= 2:
            out[:, k] = np.sqrt(residuals(p, s).mean(axis=1))
    return out


def multifractal(x: np.ndarray, scales: list[int], q_values: list[float]) -> pd.DataFrame:
    """h at the q nearest 2 with its fit, and the width of the spectrum, of the rows of a matrix (as ``mfdfa_summary``)."""
    qs = np.array(sorted(float(q) for q in q_values if q != 0))
    p, points = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1), np.zeros((len(qs), len(x), len(scales)))
    for k, s in enumerate(scales):
        if x.shape[1] // s >= 2:
            f2 = residuals(p, s)
            some = f2 > 0
            n = np.maximum(some.sum(axis=1), 1)
            safe = np.where(some, f2, 1.0)
            middle = np.where(some.any(axis=1), np.exp(np.where(some, np.log(safe), 0).sum(axis=1) / n / 2), 0)
            for j, q in enumerate(qs):
                points[j, :, k] = (np.where(some, safe ** (q / 2), 0).sum(axis=1) / n) ** (1 / q) if q > 0 else middle
    fits = [_line(f, np.array(scales, float)) for f in points]
    tau = np.array([q * f["hurst"] - 1 for q, f in zip(qs, fits)])
    alpha = (tau[2:] - tau[:-2]) / (qs[2:] - qs[:-2])[:, None]
    out = fits[int(np.abs(qs - 2).argmin())]
    out["mf_width"] = alpha.max(axis=0) - alpha.min(axis=0) if len(alpha) else np.nan
    return out


def ranges(x: np.ndarray, scales: list[int]) -> np.ndarray:
    """Mean rescaled range of the rows of a matrix at every scale; 0 where no segment varies."""
    out = np.zeros((len(x), len(scales)))
    for k, s in enumerate(scales):
        if x.shape[1] // s >= 1:
            seg = _segments(x, s, False)
            c = np.cumsum(seg - seg.mean(axis=2, keepdims=True), axis=2)
            r, sd = c.max(axis=2) - c.min(axis=2), seg.std(axis=2)
            fine = (sd > 0) & (r > 0)
            ratio = np.where(fine, r / np.where(fine, sd, 1), 0)
            out[:, k] = ratio.sum(axis=1) / np.maximum(fine.sum(axis=1), 1)
    return out


LEAST_KNOWN = 0.8
"""Share of a window's rows that must be known for it to enter a rolling series."""
Q_VALUES = [q / 2 for q in range(-10, 11)]


def window_scales(window: int, least: int = 4, most: int | None = None, count: int = 10) -> list[int]:
    """The at most five scales of a window: log-spaced from ``least`` (4 at least) to ``most`` or a quarter of the window."""
    low, high, k = max(4, least), min(window // 4 if most is None else most, window // 4), min(count, 5)
    if high <= low or k < 2:
        return []
    return sorted({int(np.rint(np.exp(np.log(low) + (np.log(high) - np.log(low)) * i / (k - 1)))) for i in range(k)})


def rolling_exponents(series: DataFrame, method: str = "dfa", window: int = 50, step: int = 1, scales: list[int] | None = None, q_values: list[float] | None = None, known: float = 1.0) -> DataFrame:
    """(series_id, win, hurst, r2, n_scales; mfdfa: mf_width) of ``rolling_windows``: a window is a list, not rows of its own.

    One sort of each series makes the lists; Arrow batches of them are analysed as
    matrices.  Nulls leave a window shorter; windows of which a smaller share than
    ``known`` is known are left out, as are those of fewer than three scales.
    """
    if window < 8:
        raise ValueError("a window has 8 rows or more")
    h = window // 2
    use = [int(s) for s in (window_scales(window) if scales is None else scales)]
    qs = Q_VALUES if q_values is None else q_values
    measure = {
        "dfa": lambda x: _line(fluctuations(x, use), np.array(use, float)), "rs": lambda x: _line(ranges(x, use), np.array(use, float)),
        "mfdfa": lambda x: multifractal(x, use, qs),
    }[method]
    fields = {"hurst": T.DoubleType(), "r2": T.DoubleType(), "n_scales": T.LongType()} | ({"mf_width": T.DoubleType()} if method == "mfdfa" else {})

    @F.pandas_udf(T.StructType([T.StructField(k, v) for k, v in fields.items()]))
    def fit(lists: pd.Series) -> pd.DataFrame:
        sizes = lists.map(len).to_numpy() if len(lists) else np.zeros(0, int)
        parts = []
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for lo in range(0, len(at), 2048):
                some = at[lo : lo + 2048]
                parts.append(measure(np.array([np.asarray(v, float) for v in lists.iloc[some]]).reshape(-1, n)).set_index(some))
        return pd.concat(parts).sort_index()[list(fields)] if parts else pd.DataFrame({k: [] for k in fields})

    by = Window.partitionBy("series_id").orderBy("t")
    rows = series.withColumns({"_x": F.collect_list("value").over(by.rowsBetween(-h, h - 1)), "_inside": F.lead("t", h).over(by).isNotNull()})
    # t numbers the rows of a series from 1.
    full = rows.where((F.size("_x") >= max(8, known * 2 * h if known == 1 else known * window)) & (F.col("t") > h) & F.col("_inside") & ((F.col("t") - h - 1) % step == 0))
    out = full.select("series_id", F.col("t").alias("win"), fit("_x").alias("f")).select("series_id", "win", "f.*").where("hurst IS NOT NULL AND NOT isnan(hurst)")
    return out.withColumn("hurst", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("hurst")))) if method == "rs" else out


def expected_rescaled_range(scale: Column) -> Column:
    """The rescaled range expected of white noise at a scale."""
    root = F.sqrt(scale * 3.141592653589793 / 2)
    return F.when(scale <= 340, root * (1 - 0.5 / scale - 0.125 / (scale * scale))).otherwise(root)


def mfdfa(rows: DataFrame, q_values: list[float] | None = None, grid: Column | None = None, strict: bool = False) -> DataFrame:
    """(series_id, win, q, h, r2, tau, alpha, d): generalised exponents and the singularity spectrum.

    q = 0 is left out.  Every negative q uses the geometric mean unless ``strict``.
    alpha is the central difference of tau over q; d = q alpha - tau.
    """
    q_values = Q_VALUES if q_values is None else q_values
    f2 = segment_residuals(rows, scale_grid(F.col("n")) if grid is None else grid).where("f2 > 0")
    qs = F.array(*[F.lit(float(q)) for q in q_values if q != 0])
    powers = f2.withColumn("q", F.explode(qs))
    means = powers.groupBy("series_id", "win", "q", "s").agg(F.avg(F.pow(F.col("f2"), F.col("q") / 2)).alias("m"), F.exp(F.avg(F.log("f2")) / 2).alias("g"))
    plain = F.pow(F.col("m"), 1 / F.col("q"))
    points = means.select("series_id", "win", "q", "s", (plain if strict else F.when(F.col("q") > 0, plain).otherwise(F.col("g"))).alias("f"))
    h = _fit(points, ["series_id", "win", "q"]).withColumnRenamed("hurst", "h").withColumn("tau", F.col("q") * F.col("h") - 1)
    by = Window.partitionBy("series_id", "win").orderBy("q")
    slope = (F.lead("tau").over(by) - F.lag("tau").over(by)) / (F.lead("q").over(by) - F.lag("q").over(by))
    return h.withColumn("alpha", slope).withColumn("d", F.col("q") * F.col("alpha") - F.col("tau")).drop("n_scales")


def mfdfa_summary(spectrum: DataFrame) -> DataFrame:
    """(series_id, win, hurst, mf_width, mf_category): h at the q nearest 2 and the spectrum's width."""
    near = F.min_by("h", F.abs(F.col("q") - 2))
    out = spectrum.groupBy("series_id", "win").agg(near.alias("hurst"), (F.max("alpha") - F.min("alpha")).alias("mf_width"))
    return out.withColumn("mf_category", ladder(F.col("mf_width"), WIDTHS))


def ladder(x: Column, steps: list[tuple[float | None, str]]) -> Column:
    """The name of the left-closed class that holds ``x``."""
    out = F.lit(steps[-1][1])
    for bound, name in reversed(steps[:-1]):
        out = F.when(x < bound, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def category(x: Column) -> Column:
    """The category of an exponent."""
    return ladder(x, CATEGORIES)


# What an exponent of each category says.
INTERPRETATIONS = {
    "strong_antipersistent": "Strong anti-persistence (mean-reverting)", "antipersistent": "Anti-persistent (mean-reverting)", "random_walk": "Random walk (no memory)",
    "persistent": "Persistent (trending)", "strong_persistent": "Strong persistence (trending)",
}
SCALINGS = ("none", "center", "standardize", "minmax", "iqr")


def interpretation(x: Column) -> Column:
    """What an exponent says, as text."""
    out = F.lit(None).cast("string")
    for name, text in INTERPRETATIONS.items():
        out = F.when(category(x) == name, text).otherwise(out)
    return out


def calculate_hurst(series: DataFrame, method: str = "dfa", scaling: str = "none", window: int | None = None, step: int = 1, min_scale: int = 4, max_scale: int | None = None, n_scales: int = 10, q_values: list[float] | None = None) -> DataFrame:
    """Exponents of whole series (series_id, win 0), or in rolling windows of every row.

    ``scaling`` is applied first (a spread of zero only centres); scales run from
    ``min_scale`` to ``max_scale``, in a window at most five up to its quarter;
    ``q_values`` are those of the multifractal method, whose exponent is h at the q
    nearest 2.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if scaling not in SCALINGS:
        raise ValueError(f"unknown scaling {scaling}")
    if scaling != "none":
        series = apply_scaling(series, scaling).select(*[c for c in series.columns if c != "value"], F.col("scaled").alias("value")).select(*series.columns)
    if window is not None:
        return rolling_hurst(series, method, window, step, min_scale, max_scale, n_scales, q_values)
    rows, grid = whole_series(series), scale_grid(F.col("n"), min_scale, max_scale, n_scales)
    if method == "mfdfa":
        found = mfdfa_summary(mfdfa(rows, q_values, grid))
    else:
        found = {"dfa": dfa, "rs": rescaled_range}[method](rows, grid)
    return found.withColumn("state", category(F.col("hurst"))).withColumn("interpretation", interpretation(F.col("hurst")))


def scaling_points(series: DataFrame, grid: Column | None = None) -> DataFrame:
    """(series_id, s, f, log_s, log_f): the fluctuation of every scale, for a log-log chart."""
    rows = whole_series(series)
    f2 = segment_residuals(rows, scale_grid(F.col("n")) if grid is None else grid)
    f = f2.groupBy("series_id", "s").agg(F.sqrt(F.avg("f2")).alias("f")).where("f > 0")
    return f.withColumns({"log_s": F.log("s"), "log_f": F.log("f")})


def hurst_summary(found: DataFrame) -> DataFrame:
    """One row a series of ``rolling_hurst``: statistics of exponents, run durations, number of changes."""
    stats = found.groupBy("series_id").agg(
        F.avg("hurst").alias("mean"), F.stddev_samp("hurst").alias("sd"), F.min("hurst").alias("min"), F.max("hurst").alias("max"), F.percentile("hurst", 0.5).alias("median"),
    )
    runs = run_lengths(found).groupBy("series_id").agg(
        F.avg("duration").alias("mean_duration"), F.max("duration").alias("max_duration"), F.min("duration").alias("min_duration"), (F.count("*") - 1).alias("n_transitions"),
    )
    return stats.join(runs, "series_id")


def state_durations(found: DataFrame) -> DataFrame:
    """(series_id, state, n, share, mean_duration) of every category that occurs."""
    states = run_lengths(found).where("state IS NOT NULL").groupBy("series_id", "state").agg(F.sum("duration").alias("n"), F.avg("duration").alias("mean_duration"))
    return states.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id")))


def state_transitions(found: DataFrame) -> DataFrame:
    """(series_id, from_state, to_state, n, probability) of neighbouring rows' categories."""
    later = F.lead("state").over(Window.partitionBy("series_id").orderBy("t"))
    moves = found.select("series_id", F.col("state").alias("from_state"), later.alias("to_state")).dropna()
    counts = moves.groupBy("series_id", "from_state", "to_state").agg(F.count("*").alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("series_id", "from_state")))


def rolling_hurst(
    series: DataFrame, method: str = "dfa", window: int = 50, step: int = 1, min_scale: int = 4, max_scale: int | None = None, n_scales: int = 10, q_values: list[float] | None = None,
) -> DataFrame:
    """(series_id, t, value, hurst, state, transition) of every row: windowed exponents, ends extended, gaps interpolated.

    Windows below 24 rows have fewer than three scales, so nothing is known there.
    ``transition`` is the step between the ranks of categories that occur.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    found = rolling_exponents(series, method, window, step, window_scales(window, min_scale, max_scale, n_scales), q_values, LEAST_KNOWN)
    at = found.select("series_id", F.col("win").alias("t"), F.col("hurst").alias("h"))
    filled = fill_gaps(series.select("series_id", "t").join(at, ["series_id", "t"], "left").select("series_id", "t", F.col("h").alias("value")))
    out = series.join(filled.withColumnRenamed("value", "hurst"), ["series_id", "t"]).withColumn("state", category(F.col("hurst")))
    return with_transition(out)


def with_transition(df: DataFrame) -> DataFrame:
    """Adds the difference of the dense ranks of present categories (``state``) between rows."""
    code = F.lit(None).cast("int")
    for k, (_, name) in enumerate(CATEGORIES):
        code = F.when(F.col("state") == name, k).otherwise(code)
    present = F.array_sort(F.collect_set("_code").over(Window.partitionBy("series_id")))
    out = df.withColumn("_code", code).withColumn("_rank", F.array_position(present, F.col("_code")))
    return out.withColumn("transition", (F.col("_rank") - F.lag("_rank").over(Window.partitionBy("series_id").orderBy("t"))).cast("int")).drop("_code", "_rank")


def compare_methods(series: DataFrame, methods: tuple[str, ...] = ("dfa", "rs"), window: int = 50, step: int = 1) -> DataFrame:
    """One column of exponents a method, side by side."""
    out = series.select("series_id", "t")
    for m in methods:
        out = out.join(rolling_hurst(series, m, window, step).select("series_id", "t", F.col("hurst").alias(f"hurst_{m}")), ["series_id", "t"])
    return out
