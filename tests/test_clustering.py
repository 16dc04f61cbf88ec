"""Mixture, linkage and medoids against plain NumPy versions, in one task and by Spark's rounds."""

import numpy as np
import pytest

from tidemark.operators import clustering, discretize

S = "series_id string, t long, value double"


def frame(spark, series):
    return spark.createDataFrame([(k, i + 1, None if v is None else float(v)) for k, x in series.items() for i, v in enumerate(x)], S)


def states(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.series_id, {})[r.t] = r.state
    return {k: [v[t] for t in sorted(v)] for k, v in out.items()}


def settled_mixture(x, k):
    """Expectation maximisation on the plain values, far beyond convergence."""
    x = np.asarray(x, float)
    m, v, w = np.quantile(x, [(i + 0.5) / k for i in range(k)]), np.full(k, max(x.var() / k**2, 1e-12)), np.full(k, 1 / k)
    for _ in range(5000):
        p = np.log(w + 1e-300) - np.log(v) / 2 - (x[:, None] - m) ** 2 / (2 * v)
        r = np.exp(p - p.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        s = r.sum(axis=0)
        m = (r * x[:, None]).sum(axis=0) / s
        v = np.maximum((r * (x[:, None] - m) ** 2).sum(axis=0) / s, x.var() * 1e-4 + 1e-12)
        w = s / len(x)
    best = p.argmax(axis=1)
    return [1 + int((m < m[b]).sum()) for b in best]


@pytest.mark.parametrize("small", [50_000, 0])
def test_mixture_settles(spark, monkeypatch, small):
    monkeypatch.setattr(clustering, "SMALL", small)
    monkeypatch.setattr(clustering, "CLOSE", 1e-8 if small else 1e-6)  # by Spark: fewer steps
    rng = np.random.default_rng(2)
    series = {"a": np.concatenate([rng.normal(0, 1, 80), rng.normal(8, 1, 60), rng.normal(15, 0.5, 60)]).round(3), "few": [1.0, 1.0, 2.0], "b": rng.normal(size=40).round(1) + np.repeat([0, 30, 90], [10, 10, 20])}
    got = states(discretize.discretize(frame(spark, series), "mixture", 3))
    assert got["few"] == [None] * 3
    for k in "ab":
        want = settled_mixture(series[k], 3)
        assert np.mean(np.array(got[k]) == want) > 0.98, k


@pytest.mark.parametrize("most", [2_000, 0])
def test_windows_by_ward(spark, monkeypatch, most):
    monkeypatch.setattr(clustering, "MAX_WINDOWS", most)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 30), rng.normal(20, 1, 30), rng.normal(-15, 1, 30)])
    got = states(discretize.discretize(frame(spark, {"x": x, "y": x[:4]}), "proxy_windowed", 3, window=6, step=2))
    w = np.array([x[i : i + 6] for i in range(0, 85, 2)])
    labels = clustering.ward_labels(w, 3)
    want = []
    for t in range(90):
        votes = [labels[j] for j, i in enumerate(range(0, 85, 2)) if i <= t < i + 6]
        want.append(min(sorted(set(votes)), key=lambda s: -votes.count(s)) if votes else None)
    assert got["x"] == want and got["y"] == [None] * 4


def warp(x, y):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            d[i, j] = abs(a - b) + (0 if i == j == 1 else min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1]))
    return d[-1, -1]


def test_windows_by_warping(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.5, 8) for c in (0, 9, 0, 20, 9, 20, 0, 9)] + [rng.normal(0, 1, 3)])
    got = states(discretize.discretize(frame(spark, {"x": x, "y": x[:10]}), "dtw", 3, window=8))
    starts = [*range(0, 64, 8), 59]  # the last window ends at the last row
    w = [x[i : i + 8] for i in starts]
    d = np.array([[warp(a, b) for b in w] for a in w])
    medoids = sorted({int((9 - 1) * (j + 0.5) / 3) for j in range(3)})
    while True:
        near = [min(medoids, key=lambda m: (d[i, m], m)) for i in range(9)]
        new = sorted(min((i for i in range(9) if near[i] == m), key=lambda i: (round(sum(d[i, j] for j in range(9) if near[j] == m), 9), i)) for m in medoids)
        if new == medoids:
            break
        medoids = new
    votes = [[medoids.index(near[i]) + 1 for i, a in enumerate(starts) if a <= t < a + 8] for t in range(67)]
    want = [min(sorted(set(v)), key=lambda label: -v.count(label)) for v in votes]
    assert got["x"] == want and got["y"] == [None] * 10


@pytest.mark.parametrize(("method", "step"), [("dtw", None), ("dtw", 3), ("proxy_windowed", 2)])
def test_short_series_are_clustered_without_rows_of_windows(spark, monkeypatch, method, step):
    rng = np.random.default_rng(5)
    series = {f"s{i}": [None if rng.random() < 0.02 else v for v in rng.integers(0, 4, size=4 + 3 * i) + np.round(rng.random(), 2)] for i in range(16)}
    rows = frame(spark, series).where("series_id <> 's9' OR t <> 17").selectExpr("*", "concat(series_id, t) AS name")  # one has a gap in t
    options = {"window": 5} | ({} if step is None else {"step": step})
    found = lambda: {r.name: (r.series_id, r.t, r.value, r.state) for r in discretize.discretize(rows, method, 3, **options).collect()}
    monkeypatch.setattr(clustering, "FEW_WINDOWS", -100)  # all by rows
    want = found()
    monkeypatch.undo()
    monkeypatch.setattr(clustering, "windows", lambda *_, **__: pytest.fail("windows as rows"))
    assert found() == want and len(want) == sum(map(len, series.values())) - 1 and {1, 2, 3} <= {w[3] for w in want.values()}
