"""Correlation tests against tabulated values and plain sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import correlation


def test_student_table():
    # Two-sided critical values of t: (degrees of freedom, t, p).
    for df, t, p in ((1, 12.706, 0.05), (5, 2.571, 0.05), (10, 3.169, 0.01), (30, 2.042, 0.05), (60, 2.660, 0.01), (120, 1.980, 0.05)):
        r = t / math.sqrt(df + t * t)
        assert float(correlation.t_test(np.array([r]), df + 2)[0]) == pytest.approx(p, rel=2e-3)
    assert correlation.t_test(np.array([0.0, 1.0, -1.0]), 9).tolist() == [1.0, 0.0, 0.0]
    assert correlation.incomplete_beta(np.array([0.3]), 2, 3)[0] == pytest.approx(0.3483)  # sum of binomial terms
    assert correlation.incomplete_beta(np.array([0.9]), 1, 1)[0] == pytest.approx(0.9)


def test_types_and_methods(spark):
    x, y = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [6.0, 5.5, 4.0, 4.5, 2.0, 1.0]
    df = spark.createDataFrame([(x, y), ([1.0, 2.0], [1.0, 2.0]), ([1.0] * 4, [1.0, 2.0, 3.0, 4.0])], "x array<double>, y array<double>")
    r = np.corrcoef(x, y)[0, 1]
    get = lambda m, k: [tuple(v.c) for v in df.select(correlation.correlation_test(F.col("x"), F.col("y"), m, k).alias("c")).collect()]
    for kind, want in (("raw", r), ("absolute", -r), ("positive", 0.0), ("negative", r)):
        got = get("pearson", kind)
        assert got[0] == (pytest.approx(want), pytest.approx(float(correlation.t_test(np.array([r]), 6)[0]))) and got[1:] == [(None, None)] * 2
    # 13 of 15 pairs are turned and one is not: S = -13; the variance without ties is n (n - 1) (2n + 5) / 18.
    tau, p = get("kendall", "raw")[0]
    assert tau == pytest.approx(-13 / 15) and p == pytest.approx(math.erfc(13 / math.sqrt(6 * 5 * 17 / 18) / math.sqrt(2)))
    assert get("spearman", "raw")[0][0] == pytest.approx(1 - 6 * 68 / (6 * 35))
    for bad in ({"method": "x"}, {"kind": "x"}):
        with pytest.raises(ValueError):
            correlation.correlation_test(F.col("x"), F.col("y"), **bad)
