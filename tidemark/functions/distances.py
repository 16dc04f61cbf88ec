"""Distances between two arrays of doubles: higher-order functions, and for rank counts and warping Arrow batches in NumPy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _over(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_over(a, b, lambda p, q: (p - q) * (p - q))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_over(a, b, lambda p, q: F.abs(p - q)))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    return F.pow(_sum(_over(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_over(a, b, lambda p, q: F.abs(p - q)))


def canberra(a: Column, b: Column) -> Column:
    """Terms whose denominator is zero are skipped."""
    return _sum(_over(a, b, lambda p, q: F.when(F.abs(p) + F.abs(q) > 0, F.abs(p - q) / (F.abs(p) + F.abs(q))).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """One minus the cosine; 1 if a norm is zero."""
    norms = F.sqrt(_sum(F.transform(a, lambda p: p * p))) * F.sqrt(_sum(F.transform(b, lambda p: p * p)))
    return F.when(norms == 0, 1.0).otherwise(1 - _sum(_over(a, b, lambda p, q: p * q)) / norms)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; null below three values or without variation."""
    n = F.size(a)
    ma, mb = _sum(a) / n, _sum(b) / n
    sab = _sum(_over(a, b, lambda p, q: (p - ma) * (q - mb)))
    saa, sbb = _sum(F.transform(a, lambda p: (p - ma) * (p - ma))), _sum(F.transform(b, lambda p: (p - mb) * (p - mb)))
    return F.when((n >= 3) & (saa > 0) & (sbb > 0), sab / F.sqrt(saa * sbb))


def ranks(a: Column) -> Column:
    """Average ranks of an array's values."""
    return F.transform(a, lambda p: F.size(F.filter(a, lambda q: q < p)) + (F.size(F.filter(a, lambda q: q == p)) + 1) / 2)


def _from_correlation(r: Column, n: Column) -> Column:
    return F.when(n >= 3, F.coalesce(1 - F.abs(r), F.lit(1.0)))


def pearson(a: Column, b: Column) -> Column:
    """One minus the absolute correlation; 1 if undefined, null below three values."""
    return _from_correlation(correlation(a, b), F.size(a))


def spearman(a: Column, b: Column) -> Column:
    return _from_correlation(correlation(ranks(a), ranks(b)), F.size(a))


def _by_length(a: pd.Series, b: pd.Series, f: Callable[[np.ndarray, np.ndarray], np.ndarray], cells: Callable[[int, int], int]) -> pd.Series:
    """``f`` of all pairs of arrays as matrices, pairs of equal lengths together and at most some four million cells at a time."""
    out = np.full(len(a), np.nan)
    null = a.isna().to_numpy() | b.isna().to_numpy()
    sizes = [(-1, -1) if bad else (len(x), len(y)) for x, y, bad in zip(a, b, null)]
    for n, m in sorted(set(sizes) - {(-1, -1)}):
        rows = np.flatnonzero([s == (n, m) for s in sizes])
        step = max(1, 4_000_000 // max(1, cells(n, m)))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            x, y = (np.array([np.asarray(v.iloc[i], float) for i in part]).reshape(len(part), k) for v, k in ((a, n), (b, m)))
            out[part] = f(x, y)
    return pd.Series(out)


def _tau(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tau-b of the rows of two matrices: pairs of places, one distance of places after another."""
    both, left, right = (np.zeros(len(x)) for _ in range(3))
    for d in range(1, x.shape[1]):
        p, q = np.sign(x[:, d:] - x[:, :-d]), np.sign(y[:, d:] - y[:, :-d])
        both += (p * q).sum(axis=1)
        left += (p * p).sum(axis=1)
        right += (q * q).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((left > 0) & (right > 0), both / np.sqrt(left * right), np.nan)


@F.pandas_udf(DoubleType())
def _kendall_tau(a: pd.Series, b: pd.Series) -> pd.Series:
    return _by_length(a, b, _tau, lambda n, _: n)


def kendall(a: Column, b: Column) -> Column:
    """One minus the absolute tau-b; 1 if undefined, null below three values."""
    tau = _kendall_tau(a, b)
    return _from_correlation(F.when(~F.isnan(tau), tau), F.size(a))


def warped(x: np.ndarray, y: np.ndarray, diagonal: float = 1.0) -> np.ndarray:
    """Warping distances of the rows of two matrices, by columns of the cost table."""
    if not x.shape[1] or not y.shape[1]:
        return np.full(len(x), np.nan)
    column = np.full((y.shape[1] + 1, len(x)), np.inf)
    for i in range(x.shape[1]):
        cost = np.abs(y.T - x[:, i])
        new = np.full_like(column, np.inf)
        for j in range(1, len(column)):
            c = cost[j - 1]
            best = np.minimum(np.minimum(column[j] + c, new[j - 1] + c), column[j - 1] + diagonal * c)
            new[j] = c if i == 0 and j == 1 else best
        column = new
    return column[-1]


@F.pandas_udf(DoubleType())
def _warping(a: pd.Series, b: pd.Series, diagonal: pd.Series) -> pd.Series:
    weight = float(diagonal.iloc[0]) if len(diagonal) else 1.0
    return _by_length(a, b, lambda x, y: warped(x, y, weight), lambda n, m: n + 2 * m)


def dtw(a: Column, b: Column, diagonal: float = 1.0) -> Column:
    """Dynamic time warping with absolute costs, all moves at cost one (``diagonal`` 2: symmetric2 steps); null if an array is empty."""
    found = _warping(a, b, F.lit(float(diagonal)))
    return F.when(~F.isnan(found), found)


METRICS: dict[str, Callable[..., Column]] = {
    "euclidean": euclidean, "manhattan": manhattan, "cosine": cosine, "minkowski": minkowski, "chebyshev": chebyshev, "canberra": canberra,
    "pearson": pearson, "spearman": spearman, "kendall": kendall, "dtw": dtw,
    "dtw_symmetric2": lambda a, b: dtw(a, b, 2.0),
    "bray_curtis": lambda a, b: manhattan(a, b) / _sum(_over(a, b, lambda p, q: F.abs(p + q))),
    "chord": lambda a, b: F.sqrt(2 * cosine(a, b)),
    "correlation_value": correlation,
}
# Other spellings.
ALIASES = {"correlation": "pearson", "supremum": "chebyshev", "dist_dtw": "dtw_symmetric2", "dist_cor": "correlation_value", "l2": "euclidean", "l1": "manhattan"}


def metric(name: str, **options) -> Callable[[Column, Column], Column]:
    """A metric by (lower-cased) name."""
    key = ALIASES.get(name.lower(), name.lower())
    if key not in METRICS:
        raise ValueError(f"unknown metric {name}; known: {', '.join(sorted({*METRICS, *ALIASES}))}")
    return lambda a, b: METRICS[key](a, b, **options)


def methods() -> list[str]:
    """The names of all metrics, with their other spellings."""
    return sorted({*METRICS, *ALIASES})


def register_metric(name: str, f: Callable[..., Column]) -> None:
    """Adds a metric: a function of two array columns."""
    METRICS[name.lower()] = f
