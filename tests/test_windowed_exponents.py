"""Windows with arguments of their own, with nulls, and with a rest at the end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clustering, discretize, hurst, proximity  # noqa: F401 (clustering registers its methods)


@pytest.fixture(scope="module")
def walk(spark):
    x = np.random.default_rng(6).normal(size=150).cumsum()
    return spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(x)], "series_id string, t long, value double"), x


def test_arguments_reach_the_windows(walk):
    s, x = walk
    got = {r.t: r.hurst for r in hurst.calculate_hurst(s, "dfa", window=60, step=10, min_scale=5, max_scale=12, n_scales=4).collect()}
    scales = hurst.window_scales(60, 5, 12, 4)
    assert scales == [5, 7, 9, 12] and hurst.window_scales(60, 5, 40, 10)[-1] == 15 and hurst.window_scales(16) == []
    for t in (31, 71, 111):
        f = hurst.fluctuations(x[None, t - 31 : t + 29], scales)[0]
        assert got[t] == pytest.approx(np.polyfit(np.log(scales), np.log(f), 1)[0])
    assert got != {r.t: r.hurst for r in hurst.calculate_hurst(s, "dfa", window=60, step=10).collect()}


def test_multifractal_windows_match_rows(walk):
    s, _ = walk
    qs = [-3.0, -1.0, 0.0, 1.0, 2.0, 3.0]
    want = hurst.mfdfa_summary(hurst.mfdfa(hurst.rolling_windows(s, 60, 10), qs, F.array(*map(F.lit, [4, 6, 9, 14])).cast("array<bigint>")))
    want = {r.win: (r.hurst, r.mf_width) for r in want.collect()}
    got = {r.win: (r.hurst, r.mf_width) for r in hurst.rolling_exponents(s, "mfdfa", 60, 10, [4, 6, 9, 14], qs).collect()}
    assert sorted(got) == sorted(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_windows_with_nulls(walk):
    s, x = walk
    holes = s.withColumn("value", F.when(~F.col("t").isin(3, 40, 41) & ~F.col("t").between(100, 130), F.col("value")))
    got = {r.win: r.hurst for r in hurst.rolling_exponents(holes, "dfa", 50, 1, [4, 6, 9], known=hurst.LEAST_KNOWN).collect()}
    known = [None if i + 1 in (3, 40, 41) or 100 <= i + 1 <= 130 else v for i, v in enumerate(x)]
    for win in range(26, 126):
        rows = np.array([v for v in known[win - 26 : win + 24] if v is not None])
        if len(rows) < 40:
            assert win not in got
        else:
            assert got[win] == pytest.approx(np.polyfit(np.log([4, 6, 9]), np.log(hurst.fluctuations(rows[None, :], [4, 6, 9])[0]), 1)[0])


def test_last_rows_get_a_window(walk):
    s, x = walk
    last = proximity.windows(s, 8, tail=True).orderBy(F.desc("window_id")).first()
    assert (last.window_id, last.start_t, last.end_t) == (19, 143, 150) and last.x == x[142:].tolist()
    assert proximity.windows(s, 10, tail=True).count() == 15 == proximity.windows(s, 10).count()
    for name in ("dtw", "proxy_windowed"):
        assert discretize.discretize(s, name, 3, window=8, step=4).where("state IS NULL").count() == 0
