"""Optimal one-dimensional k-means against all partitions."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import discretize


def _cost(x, n, cuts):
    total = 0.0
    for a, b in itertools.pairwise([0, *cuts, len(x)]):
        m = np.average(x[a:b], weights=n[a:b])
        total += float((n[a:b] * (x[a:b] - m) ** 2).sum())
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(1, 4)), min_size=4, max_size=10, unique_by=lambda p: p[0]), st.integers(2, 4))
def test_cuts_cost_no_more_than_any_others(points, k):
    points.sort()
    x, n = np.array([p[0] for p in points], float), np.array([p[1] for p in points])
    found = discretize.optimal_cuts(x, n, k)
    least = min(_cost(x, n, c) for c in itertools.combinations(range(1, len(x)), k - 1))
    assert list(found) == sorted(set(found.tolist())) and _cost(x, n, found) == pytest.approx(least, abs=1e-9)


def test_many_values_equal_the_plain_recurrence():
    rng = np.random.default_rng(8)
    x, n, k = np.sort(rng.lognormal(0, 1.5, 400)), rng.integers(1, 5, 400), 5
    best = [_cost(x[:i], n[:i], []) if i else np.inf for i in range(401)]
    for _ in range(k - 1):
        c, s, q = (np.concatenate([[0], np.cumsum(n * x**p)]) for p in range(3))
        best = [min((best[j] + q[i] - q[j] - (s[i] - s[j]) ** 2 / (c[i] - c[j]) for j in range(1, i)), default=np.inf) for i in range(401)]
    assert _cost(x, n, discretize.optimal_cuts(x, n, k)) == pytest.approx(best[400])


def test_states_cost_no_more_than_settled_ones(spark):
    rng = np.random.default_rng(3)
    series = {f"s{i}": np.round(np.concatenate([rng.normal(0, 1, 30), rng.normal(20, 1, 30), rng.normal(24, 1, 30 + 400 * (i % 2))]), 3) for i in range(4)}
    odd = [("s0", 900, None), ("s0", 901, float("nan")), ("flat", 1, 2.0), ("flat", 2, 2.0), ("none", 1, None)]
    rows = [(sid, i, float(v)) for sid, x in series.items() for i, v in enumerate(x)] + odd
    s = spark.createDataFrame(rows, "series_id string, t long, value double")
    best, settled = ({(r.series_id, r.t): r.state for r in discretize.discretize(s, m, 3).collect()} for m in ("kmeans_optimal", "kmeans"))
    assert len(best) == len(rows) and all(best[r[:2]] is None for r in odd)

    def cost(states, sid, x):
        at = np.array([states[sid, i] for i in range(len(x))])
        return sum(((x[at == j] - x[at == j].mean()) ** 2).sum() for j in set(at))

    costs = [(cost(best, sid, x), cost(settled, sid, x)) for sid, x in series.items()]
    assert all(b <= c + 1e-9 for b, c in costs) and any(b < c - 1 for b, c in costs)


def test_series_beyond_the_bound_settle_instead(spark, monkeypatch):
    monkeypatch.setattr(discretize, "EXACT_VALUES", 20)
    rows = [(s, i, float(i * i % 97)) for s, n in (("short", 15), ("long", 60)) for i in range(n)]
    s = spark.createDataFrame(rows, "series_id string, t long, value double")
    got = discretize.discretize(s, "kmeans_optimal", 3).collect()
    settled = {(r.series_id, r.t): r.state for r in discretize.discretize(s, "kmeans", 3).collect()}
    assert len(got) == len(rows) and all(r.state == settled["long", r.t] for r in got if r.series_id == "long")
