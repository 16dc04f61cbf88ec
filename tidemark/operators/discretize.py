"""Discretisers: series values to states 1..k, each series by itself.

A discretiser takes (series, k) and returns the series with ``state``; ``register``
adds one.  Where a series has fewer distinct values than states, or breaks coincide,
its states are null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bin_of, quantiles
from ..sources.tables import written

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Adds a discretiser under a name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _REGISTRY[name] = f
        return f

    return add


def methods() -> list[str]:
    """The names of all discretisers."""
    return sorted(_REGISTRY)


def discretize(series: DataFrame, method: str = "quantile", k: int = 5, **options) -> DataFrame:
    """``series`` with ``state`` (INT) by a registered method."""
    if method not in _REGISTRY:
        raise ValueError(f"unknown method {method}; known: {', '.join(methods())}")
    if k < 2:
        raise ValueError("at least two states")
    return _REGISTRY[method](series, k, **options)


def _with(series: DataFrame, **stats: Column) -> DataFrame:
    return series.join(series.groupBy("series_id").agg(*[c.alias(f"_{n}") for n, c in stats.items()]), "series_id")


def _done(df: DataFrame, series: DataFrame, state: Column) -> DataFrame:
    return df.withColumn("state", state.cast("int")).select(*series.columns, "state")


def _even(k: int) -> list[float]:
    return [i / k for i in range(k + 1)]


def _distinct_breaks(breaks: Column) -> Column:
    return F.size(F.array_distinct(breaks)) == F.size(breaks)


@register("quantile")
def by_quantile(series: DataFrame, k: int, probs: list[float] | None = None) -> DataFrame:
    """Bins between type-7 quantiles."""
    df = _with(series, breaks=quantiles("value", probs or _even(k)), u=F.count_distinct("value"))
    return _done(df, series, F.when((F.col("_u") >= k) & _distinct_breaks(F.col("_breaks")), bin_of(F.col("value"), F.col("_breaks"))))


@register("equal_width")
def by_width(series: DataFrame, k: int) -> DataFrame:
    """Bins of equal width over the range."""
    df = _with(series, lo=F.min("value"), hi=F.max("value"), u=F.count_distinct("value"))
    breaks = F.array(*[F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / k), 10) for i in range(k + 1)])
    return _done(df.withColumn("_breaks", breaks), series, F.when(F.col("_u") >= k, bin_of(F.col("value"), F.col("_breaks"))))


@register("symbolic")
def by_symbol(series: DataFrame, k: int) -> DataFrame:
    """Bins of the z-score between normal quantiles."""
    df = _with(series, m=F.avg("value"), s=F.stddev_samp("value"))
    z = F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))
    cuts = [NormalDist().inv_cdf(i / k) for i in range(1, k)]
    return _done(df, series, F.when((F.col("_s") > 0) & z.isNotNull(), reduce(lambda a, b: a + b, [(z > c).cast("int") for c in cuts]) + 1))


@register("magnitude")
def by_magnitude(series: DataFrame, k: int) -> DataFrame:
    """Bins of the absolute value between log-spaced breaks from range/k to the range, and beyond."""
    df = _with(series, r=F.max("value") - F.min("value"))
    cuts = [F.round(F.col("_r") / k * F.pow(F.lit(float(k)), F.lit(i / (k - 1))), 10) for i in range(k)]
    x = F.abs("value")
    return _done(df, series, F.when(x.isNotNull() & (F.col("_r") > 0), reduce(lambda a, b: a + b, [(x > c).cast("int") for c in cuts]) + 1))


@register("percentile_magnitude")
def by_percentile_magnitude(series: DataFrame, k: int, probs: list[float] | None = None) -> DataFrame:
    """Quantile bins of the absolute value; given probabilities are clamped to 0..1 and get both ends."""
    use = sorted({0.0, 1.0, *(min(1.0, max(0.0, p)) for p in probs)}) if probs else _even(k)
    df = _with(series.withColumn("_a", F.abs("value")), breaks=quantiles("_a", use))
    return _done(df, series, F.when(_distinct_breaks(F.col("_breaks")), bin_of(F.col("_a"), F.col("_breaks"))))


@register("adaptive_magnitude")
def by_adaptive_magnitude(series: DataFrame, k: int, window: int = 10) -> DataFrame:
    """Quantile bins of the z-score against the last ``window`` values."""
    by = Window.partitionBy("series_id").orderBy("t")
    frame = by.rowsBetween(-(window - 1), 0)
    z = F.round(F.try_divide(F.col("value") - F.avg("value").over(frame), F.stddev_samp("value").over(frame)), 9)
    full = F.row_number().over(by) >= window
    df = _with(series.withColumn("_z", F.when(full & ~F.isnan(z), z)), breaks=quantiles("_z", _even(k)))
    return _done(df, series, F.when(_distinct_breaks(F.col("_breaks")), bin_of(F.col("_z"), F.col("_breaks"))))


@register("change_points")
def by_change_points(series: DataFrame, k: int) -> DataFrame:
    """Cuts after the k - 1 largest absolute steps (earlier ones first among equals)."""
    by = Window.partitionBy("series_id").orderBy("t")
    step = F.abs(F.lead("value").over(by) - F.col("value"))
    df = series.withColumns({"_d": F.round(step, 10), "_n": F.count("*").over(Window.partitionBy("series_id"))})
    largest = Window.partitionBy("series_id").orderBy(F.desc_nulls_last("_d"), "t")
    df = df.withColumn("_cut", (F.row_number().over(largest) <= k - 1) & F.col("_d").isNotNull())
    before = F.sum(F.col("_cut").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return _done(df, series, F.when(F.col("_n") >= 2 * k, 1 + F.coalesce(before, F.lit(0))))


@register("entropy")
def by_entropy(series: DataFrame, k: int, candidates: int = 20) -> DataFrame:
    """Of ``candidates`` bin widths the one of largest entropy, if it makes k bins; else equal widths."""
    df = _with(series, lo=F.min("value"), hi=F.max("value"), u=F.count_distinct("value"))
    r = F.col("_hi") - F.col("_lo")
    tried = df.withColumn("_c", F.explode(F.array(*[F.lit(i) for i in range(candidates)])))
    width = r / (2 * k) + (r / k - r / (2 * k)) * F.col("_c") / (candidates - 1)
    start, stop = F.col("_lo") - 0.001 * r, F.col("_hi") + 0.001 * r
    # Breaks run from start by width as far as they fit; the last is moved up to the maximum.
    n_bins = F.greatest(F.lit(1), F.floor(F.round(F.try_divide(stop - start, width), 9)))
    at = F.greatest(F.lit(1), F.least(n_bins, F.ceil(F.round(F.try_divide(F.col("value") - start, width), 9))))
    binned = tried.where("value IS NOT NULL").select("series_id", "_c", n_bins.alias("_bins"), at.alias("_b"))
    counts = binned.groupBy("series_id", "_c", "_bins", "_b").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("series_id", "_c"))
    p = F.col("_n") / F.col("_total")
    entropy = counts.withColumn("_total", total).groupBy("series_id", "_c", "_bins").agg(F.round(-F.sum(p * F.log(p)), 9).alias("_e"))
    best = entropy.groupBy("series_id").agg(F.max(F.struct("_e", (-F.col("_c")).alias("c"), "_bins")).alias("x")).select("series_id", (-F.col("x.c")).alias("_c"), F.col("x._bins").alias("_bins"))
    df = df.join(best, "series_id")
    own = F.greatest(F.lit(1), F.least(F.lit(k), F.ceil(F.round(F.try_divide(F.col("value") - start, width), 9))))
    even = F.array(*[F.round(F.col("_lo") + r * (i / k), 10) for i in range(k + 1)])
    state = F.when(F.col("_bins") == k, own).otherwise(bin_of(F.col("value"), even))
    return _done(df, series, F.when((F.col("_u") >= k) & F.col("value").isNotNull(), state))


@register("kmeans")
def by_kmeans(series: DataFrame, k: int) -> DataFrame:
    """One-dimensional k-means from evenly spaced quantiles, until it settles; states ascend with their centres.

    Each step is one grouped aggregation that ends in a written table: in one dimension
    a value's nearest centre is found by counting the midpoints below it.  A series is
    done when no cluster's number of values changes: clusters are runs of the sorted
    values, so equal numbers are equal clusters.
    """
    start = quantiles("value", [(i + 0.5) / k for i in range(k)])
    first = series.groupBy("series_id").agg(start.alias("_centres"), F.count_distinct("value").alias("_u")).where(F.col("_u") >= k)
    points = written(series.where("value IS NOT NULL").groupBy("series_id", "value").agg(F.count("*").alias("_n")), "points")
    moving = written(first.select("series_id", "_centres", F.array(*[F.lit(-1).cast("long")] * k).alias("_sizes")), "centres")
    settled = []
    while not moving.isEmpty():
        placed = points.join(moving, "series_id").withColumn("_s", _nearest(F.col("value"), F.col("_centres")))
        means = placed.groupBy("series_id", "_s").agg(F.first("_centres").alias("_centres"), F.first("_sizes").alias("_sizes"), F.sum("_n").alias("_c"), (F.sum(F.col("value") * F.col("_n")) / F.sum("_n")).alias("_m"))
        found = means.groupBy("series_id").agg(F.first("_centres").alias("_centres"), F.first("_sizes").alias("_sizes"), *[F.map_from_entries(F.collect_list(F.struct("_s", c))).alias(f"{c}s") for c in ("_c", "_m")])
        moved = F.array_sort(F.transform("_centres", lambda c, i: F.coalesce(F.element_at("_ms", (i + 1).cast("int")), c)))
        sizes = F.array(*[F.coalesce(F.element_at("_cs", F.lit(j + 1)), F.lit(0)) for j in range(k)])
        step = written(found.select("series_id", moved.alias("_centres"), sizes.alias("_sizes"), (F.col("_sizes") == sizes).alias("_same")), "centres")
        settled.append(step.where("_same").select("series_id", "_centres"))
        moving = step.where("NOT _same").drop("_same")
    centres = reduce(DataFrame.unionByName, settled, first.where("false").select("series_id", "_centres"))
    return _done(series.join(centres, "series_id", "left"), series, _nearest(F.col("value"), F.col("_centres")))


EXACT_VALUES = 1 << 20


@register("kmeans_optimal")
def by_optimal_means(series: DataFrame, k: int) -> DataFrame:
    """One-dimensional k-means of the least sum of squares that any k clusters have; states ascend with their centres.

    In one dimension clusters are runs of the sorted distinct values, so the best cuts
    follow from the best cuts of every beginning into one cluster less.  A worker gets the
    values with their numbers (``EXACT_VALUES`` at most, some 100 bytes each) and gives
    back k - 1 cuts; rows themselves are joined to these.  A series of more distinct
    values gets the settled centres of ``kmeans``.  Of equal sums the one with the
    smallest last cut counts, then the smallest one before.
    """
    points = written(series.where("value IS NOT NULL AND NOT isnan(value)").groupBy("series_id", "value").agg(F.count("*").alias("_n")), "points")
    sizes = points.groupBy("series_id").agg(F.count("*").alias("_u"))
    fits = points.join(sizes.where((F.col("_u") >= k) & (F.col("_u") <= EXACT_VALUES)), "series_id")

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        ends = optimal_cuts(part["value"].to_numpy(), part["_n"].to_numpy(), k)
        return pd.DataFrame({"series_id": part["series_id"].iloc[:1], "_tops": [part["value"].to_numpy()[ends - 1].tolist()]})

    id_type = series.schema["series_id"].dataType.simpleString()
    tops = fits.groupBy("series_id").applyInPandas(cut, f"series_id {id_type}, _tops array<double>")
    above = F.size(F.filter("_tops", lambda b: F.col("value") > b)) + 1
    known = F.col("value").isNotNull() & ~F.isnan("value") & F.col("_tops").isNotNull()
    out = _done(series.join(tops, "series_id", "left"), series, F.when(known, above))
    large = written(sizes.where(F.col("_u") > EXACT_VALUES).select("series_id"), "large")
    if large.isEmpty():
        return out
    return out.join(large, "series_id", "left_anti").unionByName(by_kmeans(series.join(large, "series_id", "left_semi"), k))


def optimal_cuts(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k - 1 numbers of ascending distinct ``values`` that lie below each cut, for the least sum of squares.

    The best last cut of a beginning never moves left as the beginning grows, so for all
    beginnings together the middle one's cut halves the places to look at for the others;
    beginnings of one depth are looked at together.
    """
    n = len(values)
    x = values - values[n // 2]  # sums near zero lose fewer digits
    c = np.concatenate([[0.0], np.cumsum(counts)])
    s = np.concatenate([[0.0], np.cumsum(counts * x)])
    q = np.concatenate([[0.0], np.cumsum(counts * x * x)])

    def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum of squares around the mean of values a to b - 1."""
        return np.maximum(q[b] - q[a] - (s[b] - s[a]) ** 2 / (c[b] - c[a]), 0.0)

    best = np.full(n + 1, np.inf)
    best[1:] = spread(np.zeros(n, int), np.arange(1, n + 1))
    froms = []
    for clusters in range(2, k + 1):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        # Spans of beginnings (lo..hi) and the cuts that their best ones lie between.
        lo, hi, first, last = (np.array([v]) for v in (clusters, n, clusters - 1, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            wide = np.minimum(last, mid - 1) - first + 1
            start = np.concatenate([[0], np.cumsum(wide)[:-1]])
            which = np.repeat(np.arange(len(mid)), wide)
            cuts = np.arange(wide.sum()) - start[which] + first[which]
            cost = best[cuts] + spread(cuts, mid[which])
            least = np.minimum.reduceat(cost, start)
            hit = np.flatnonzero(cost == least[which])
            new[mid], at[mid] = least, cuts[hit[np.searchsorted(hit, start)]]
            halves = np.stack([np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([first, at[mid]]), np.concatenate([at[mid], last])])
            lo, hi, first, last = halves[:, halves[0] <= halves[1]]
        best = new
        froms.append(at)
    cut, out = n, []
    for at in reversed(froms):
        cut = int(at[cut])
        out.append(cut)
    return np.array(out[::-1], dtype=int)


def _nearest(x: Column, centres: Column) -> Column:
    between = F.zip_with(F.slice(centres, 1, F.size(centres) - 1), F.slice(centres, 2, F.size(centres) - 1), lambda a, b: (a + b) / 2)
    return F.when(x.isNotNull() & centres.isNotNull(), F.size(F.filter(between, lambda b: x > b)) + 1)


def discretize_pair(a: DataFrame, b: DataFrame, k: int, method: str = "quantile") -> DataFrame:
    """Two sets of series (series_id, t, value) on common breaks per series_id: (series_id, t, a, b)."""
    if method not in ("quantile", "equal_width"):
        raise ValueError(f"unsupported method {method}")
    both = a.withColumn("_w", F.lit("a")).unionByName(b.withColumn("_w", F.lit("b")))
    states = discretize(both, method, k)
    side = lambda w: states.where(F.col("_w") == w).select("series_id", "t", F.col("state").alias(w))
    return side("a").join(side("b"), ["series_id", "t"])


def quantile_states(series: DataFrame, k: int = 4, probs: list[float] | None = None, labels: list[str] | None = None, na_label: str | None = None, right: bool = False) -> DataFrame:
    """``series`` with a text state Q1..Qk by quantiles: left-closed bins with the top included, or right-closed."""
    use = probs or _even(k)
    names = labels or [f"Q{i + 1}" for i in range(len(use) - 1)]
    if len(names) != len(use) - 1:
        raise ValueError("one label for each bin")
    df = _with(series, breaks=quantiles("value", use))
    x, b = F.col("value"), F.col("_breaks")
    inner = F.filter(b, lambda q, i: (i > 0) & (i < F.size(b) - 1) & ((x > q) if right else (x >= q)))
    at = F.when(F.element_at(b, 1) == F.element_at(b, -1), 1).when((x >= F.element_at(b, 1)) & (x <= F.element_at(b, -1)), F.size(inner) + 1)
    known = F.element_at(F.array(*[F.lit(n) for n in names]), at)
    fine = _distinct_breaks(b) | (F.element_at(b, 1) == F.element_at(b, -1))
    out = F.when(x.isNull(), F.lit(na_label)).when(fine, known)
    return df.withColumn("state", out).select(*series.columns, "state")


def map_to_state(series: DataFrame, ranges: dict[str, str] | None = None, breaks: list[float] | None = None, bins: int | None = None, function: Callable[[Column], Column] | None = None) -> DataFrame:
    """``series`` with a text state by a function of the value, named ranges, breaks or a number of equal bins.

    Ranges read "a-b" (both included), "<x", ">x", "=x" or a number; the first that fits
    wins.  Breaks make right-closed bins.  Without any, the value's text is the state.
    """
    x = F.col("value")
    if function is not None:
        return series.withColumn("state", function(x).cast("string"))
    if ranges is not None:
        state = F.lit(None).cast("string")
        for name, text in reversed(ranges.items()):
            text = text.strip()
            if text[0] in "<>=":
                v = float(text[1:])
                fits = {"<": x < v, ">": x > v, "=": x == v}[text[0]]
            elif "-" in text:
                a, b = (float(p) for p in text.split("-"))
                fits = (x >= a) & (x <= b)
            else:
                fits = x == float(text)
            state = F.when(fits, name).otherwise(state)
        return series.withColumn("state", state)
    if breaks is not None:
        b = F.array(*[F.lit(float(v)) for v in sorted(breaks)])
        return series.withColumn("state", F.concat(F.lit("Bin_"), bin_of(x, b).cast("string")))
    if bins is not None:
        df = _with(series, lo=F.min("value"), hi=F.max("value"))
        b = F.array(*[F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / bins), 10) for i in range(bins + 1)])
        at = F.when(F.col("_lo") == F.col("_hi"), F.lit(1)).otherwise(bin_of(x, F.col("_b")))
        return df.withColumn("_b", b).withColumn("state", F.concat(F.lit("Bin_"), at.cast("string"))).select(*series.columns, "state")
    return series.withColumn("state", x.cast("string"))
