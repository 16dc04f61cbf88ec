"""Correlations of two arrays with their significance, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .distances import _by_length, _tau

METHODS = ("pearson", "spearman", "kendall")
TYPES = ("absolute", "positive", "negative", "raw")


def incomplete_beta(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that is quick."""
    x = np.clip(np.asarray(x, float), 0, 1)
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 300):
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(z <= 0, 0.0, front * value)
    return np.where(turn, 1 - out, out)


def t_test(r: np.ndarray, n: int) -> np.ndarray:
    """Two-sided p of a correlation of ``n`` pairs, by Student's distribution."""
    return incomplete_beta(1 - np.asarray(r, float) ** 2, (n - 2) / 2, 0.5)


def kendall_test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two-sided p of the rows' Kendall correlation, by the normal distribution with its variance under ties."""
    n = x.shape[1]
    s = np.zeros(len(x))
    for d in range(1, n):
        s += (np.sign(x[:, d:] - x[:, :-d]) * np.sign(y[:, d:] - y[:, :-d])).sum(axis=1)

    def ties(v: np.ndarray) -> np.ndarray:
        sizes = [np.unique(row, return_counts=True)[1].astype(float) for row in v]
        return np.array([[(t * (t - 1) * (2 * t + 5)).sum(), (t * (t - 1)).sum(), (t * (t - 1) * (t - 2)).sum()] for t in sizes]).reshape(-1, 3)

    a, b = ties(x), ties(y)
    variance = (n * (n - 1) * (2 * n + 5) - a[:, 0] - b[:, 0]) / 18 + a[:, 1] * b[:, 1] / (2 * n * (n - 1)) + a[:, 2] * b[:, 2] / (9 * n * (n - 1) * (n - 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(s) / np.sqrt(variance)
    return np.array([math.erfc(v / math.sqrt(2)) if np.isfinite(v) else np.nan for v in z])


def rank_rows(x: np.ndarray) -> np.ndarray:
    """Average ranks within each row."""
    return np.array([pd.Series(row).rank().to_numpy() for row in x]).reshape(x.shape)


def pearson_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's correlation of the rows of two matrices; NaN without variation."""
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _correlated(x: np.ndarray, y: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    if x.shape != y.shape:
        raise ValueError("vectors differ in length")
    if x.shape[1] < 3:
        return np.full(len(x), np.nan), np.full(len(x), np.nan)
    if method == "kendall":
        return _tau(x, y), kendall_test(x, y)
    r = pearson_rows(x, y) if method == "pearson" else pearson_rows(rank_rows(x), rank_rows(y))
    return r, np.where(np.isnan(r), np.nan, t_test(np.clip(np.nan_to_num(r), -1, 1), x.shape[1]))


def correlation_test(a: Column, b: Column, method: str = "pearson", kind: str = "absolute") -> Column:
    """A struct of correlation and p_value (two-sided, of the raw correlation) of two arrays of one length.

    ``kind`` gives the size of the correlation, only its positive or negative part
    (zero otherwise), or the raw value.  Pearson and Spearman are tested by Student's t,
    Kendall by the normal distribution.  Null below three values or without variation.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind}")
    shape = {"absolute": np.abs, "positive": lambda r: np.maximum(r, 0), "negative": lambda r: np.minimum(r, 0), "raw": lambda r: r}[kind]

    @F.pandas_udf("correlation double, p_value double")
    def tested(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found: list[pd.Series] = [_by_length(a, b, lambda x, y, i=i: _correlated(x, y, method)[i], lambda n, _: n) for i in (0, 1)]
        return pd.DataFrame({c: v.astype(object).where(v.notna(), None) for c, v in zip(("correlation", "p_value"), (shape(found[0]), found[1]))})

    return tested(a, b)
