"""The full early warning over a whole series."""

import datetime

import numpy as np

from tidemark.plans.hurst_warnings import stated
from tidemark.plans.queries import QUERIES
from tidemark.plans.registry import SERIES

DAYS = 440


def test_full_warning_covers_the_series(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(10, 1, 250), 10 + np.cumsum(rng.normal(0, 1, DAYS - 250))])
    first = datetime.date(1995, 1, 1)
    rows = [(first + datetime.timedelta(days=i), float(x) * 100_000) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.t: r for r in QUERIES["ews_full"](spark, str(tmp_path)).collect()}
    values = {r.t: r.value for r in stated(SERIES["s2"](spark, str(tmp_path))).collect()}
    assert set(got) == set(values) == set(range(1, DAYS + 1))
    # Quantiles are those of the whole series.
    x = np.array([values[t] for t in sorted(values)], float)
    low, high = np.nanquantile(x, [0.05, 0.95])
    for t in got:
        if min(abs(values[t] - low), abs(values[t] - high)) > 1e-9:
            assert (got[t].extreme_low, got[t].extreme_high) == (values[t] < low, values[t] > high), t
    vol = np.array([x[i - 29 : i + 1].std() if i >= 29 else np.nan for i in range(DAYS)])
    top = np.nanquantile(vol, 0.9)
    assert all(got[i + 1].high_volatility == (vol[i] > top) for i in range(29, DAYS) if abs(vol[i] - top) > 1e-9)
