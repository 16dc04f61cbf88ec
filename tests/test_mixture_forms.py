"""Mixtures whose components share one variance, and what stands in for a mixture with idle components."""

import numpy as np
import pytest

from tidemark.operators import clustering, discretize

S = "series_id string, t long, value double"
K = 3


def fitted(x, equal):
    """Expectation maximisation on the plain values; (states, number of states)."""
    x = np.asarray(x, float)
    m, v, w = np.quantile(x, [(i + 0.5) / K for i in range(K)]), np.full(K, max(x.var() / K**2, 1e-12)), np.full(K, 1 / K)
    before = -np.inf
    while True:
        p = np.log(w + 1e-300) - np.log(v) / 2 - (x[:, None] - m) ** 2 / (2 * v)
        top = p.max(axis=1, keepdims=True)
        likelihood = (np.log(np.exp(p - top).sum(axis=1)) + top[:, 0]).mean()
        if likelihood - before < clustering.CLOSE:
            break
        before = likelihood
        r = np.exp(p - top)
        r /= r.sum(axis=1, keepdims=True)
        s = r.sum(axis=0)
        m = np.where(s > 0, (r * x[:, None]).sum(axis=0) / np.where(s > 0, s, 1), m)
        around = (r * (x[:, None] - m) ** 2).sum(axis=0)
        v = np.full(K, around.sum() / len(x)) if equal else around / np.where(s > 0, s, 1)
        v = np.maximum(v, x.var() * 1e-4 + 1e-12)
        w = s / len(x)
    best = p.argmax(axis=1)
    states = [1 + int((m < m[b]).sum()) for b in best]
    return states, len(set(states))


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(12)
    apart = np.concatenate([rng.normal(c, 0.4, 30) for c in (0, 6, 14)]).round(4)
    few = np.repeat([0.0, 1.0, 50.0], [40, 1, 40])
    series = {"apart": apart, "few": few, "heavy": rng.standard_t(1.2, 90).round(4), "flat": rng.uniform(0, 1, 60).round(4), "lump": np.concatenate([np.full(50, 5.0), [5.1, 5.2, 9.0]])}
    r = np.random.default_rng(50)  # one wide component hides another unless all are equally wide
    series["hidden"] = np.round(np.concatenate([r.normal(0, 1, r.integers(10, 40)), r.normal(r.uniform(0, 4), r.uniform(0.1, 4), r.integers(5, 40))]), 2)
    series |= {f"r{i}": rng.choice([rng.lognormal(0, 1.5, 25), rng.integers(0, 4, 25)], axis=0).round(3) for i in range(8)}
    return series


@pytest.mark.parametrize("small", [50_000, 0])
def test_forms_in_turn(spark, monkeypatch, shapes, small):
    monkeypatch.setattr(clustering, "SMALL", small)
    monkeypatch.setattr(clustering, "CLOSE", 1e-8 if small else 1e-3)  # by Spark: few steps
    some = shapes if small else {k: shapes[k] for k in ("apart", "few", "lump")}
    rows = [(k, t, float(v)) for k, x in some.items() for t, v in enumerate(x)] + [("apart", 999, None), ("apart", 1000, float("nan")), ("two", 1, 1.0), ("two", 2, 2.0)]
    s = spark.createDataFrame(rows, S)
    got = {(r.series_id, r.t): r.state for r in discretize.discretize(s, "mixture", K).collect()}
    means = {(r.series_id, r.t): r.state for r in discretize.discretize(s, "kmeans_optimal", K).collect()}
    assert len(got) == len(rows) and all(got[k] is None for k in (("apart", 999), ("apart", 1000), ("two", 1), ("two", 2)))
    forms = set()
    for k, x in some.items():
        (own, n), (one, m) = fitted(x, False), fitted(x, True)
        form = "own" if n == K else "equal" if m == K else "means"
        forms.add(form)
        want = {"own": own, "equal": one, "means": [means[k, t] for t in range(len(x))]}[form]
        assert np.mean([got[k, t] == want[t] for t in range(len(x))]) > 0.98, (k, form)
        assert len({got[k, t] for t in range(len(x))}) == K
    if small:
        assert forms == {"own", "equal", "means"}


def test_short_series_are_fitted_together(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [(f"s{i}", t + 1, float(round(x, 1))) for i in range(24) for t, x in enumerate(rng.normal(rng.integers(0, 3, 20 + 3 * i) * 8.0, 1 + i % 3))]
    series = spark.createDataFrame(rows, "series_id string, t long, value double").coalesce(1)
    states = lambda: {(r.series_id, r.t): r.state for r in discretize.discretize(series, "mixture", 3).collect()}
    together = states()
    monkeypatch.setattr(clustering, "SHORT", 0)  # each in a group of its own
    assert together == states() and len(together) == len(rows)
    values, n = np.array([[0.0, 1, 5, 6, 6], [0, 2, 4, 9, 11]]), np.array([[2.0, 1, 1, 3, 0], [1, 1, 1, 1, 1]])
    start = [np.array([[1.0, 5], [2, 9]]), np.ones((2, 2)), np.full((2, 2), 0.5)]
    both = clustering.mixture_fits(values, n, *start, np.full(2, 1e-3))
    for i, wide in enumerate((4, 5)):
        alone = clustering.mixture_fits(values[i : i + 1, :wide], n[i : i + 1, :wide], *(c[i : i + 1] for c in start), np.full(1, 1e-3))
        assert all(np.allclose(a[i], b[0], rtol=0, atol=1e-9) for a, b in zip(both, alone))
