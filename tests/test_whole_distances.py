"""The slow distance queries over a whole series, against brute force."""

import datetime

import numpy as np
import pytest

from tidemark.plans.queries import QUERIES

DAYS = 640


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(11).permutation(10_000)[:DAYS] / 100  # without ties


@pytest.fixture(scope="module")
def folder(spark, values, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    first = datetime.date(1995, 1, 1)
    rows = [(first + datetime.timedelta(days=i), float(v) * 100_000) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "o_orderdate date, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return path


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def spearman(x, y):
    return 1 - abs(np.corrcoef(ranks(x), ranks(y))[0, 1])


def kendall(x, y):
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return 1 - abs((a * b).sum() / (len(x) * (len(x) - 1)))


def warp(x, y, diagonal):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            c = abs(a - b)
            d[i, j] = c if i == j == 1 else min(d[i - 1, j] + c, d[i, j - 1] + c, d[i - 1, j - 1] + diagonal * c)
    return d[-1, -1]


@pytest.mark.parametrize("name, size, step, distance", [
    ("dist_spearman", 60, 40, spearman), ("dist_kendall", 60, 40, kendall),
    ("dist_dtw", 20, 20, lambda x, y: warp(x, y, 1)), ("dist_dtw_symmetric2", 20, 20, lambda x, y: warp(x, y, 2)),
])
def test_every_pair_of_windows(spark, folder, values, name, size, step, distance):
    w = [values[i : i + size] for i in range(0, DAYS - size + 1, step)]
    assert size + step * (len(w) - 1) > DAYS - step and step <= size  # no day is between windows or far beyond the last
    got = {(r.src, r.dst): r.distance for r in QUERIES[name](spark, folder).collect()}
    assert set(got) == {(i + 1, j + 1) for i in range(len(w)) for j in range(i + 1, len(w))}
    for (i, j), d in got.items():
        assert d == pytest.approx(distance(w[i - 1], w[j - 1]), abs=2e-7), (i, j)
