"""Rates meet the targets of rare domains too."""

import logging

import numpy as np
import pytest

from tidemark.llm import mixing

ROWS = "n_tokens long, posterior array<double>"


def fitted(spark, p, t, targets):
    rows = [(int(n), [float(x) for x in q]) for n, q in zip(t, p)]
    m = mixing.Mixture([f"d{i}" for i in range(p.shape[1])], np.zeros((p.shape[1], 4)))
    return mixing.fit_rates(spark.createDataFrame(rows, ROWS), m, targets, 0.7)


@pytest.mark.parametrize("soft", [0.0, 0.02])
def test_rare_domains_reach_their_targets(spark, soft):
    rng = np.random.default_rng(8)
    which = np.repeat([0, 1, 2], [1960, 30, 10])
    p = (1 - soft) * np.eye(3)[which] + soft * rng.dirichlet([1, 1, 1], 2000)
    t = rng.integers(50, 150, 2000)
    for targets in ({"d0": 0.8, "d1": 0.15, "d2": 0.05}, {"d0": 0.98, "d1": 0.005, "d2": 0.015}, None):
        m = fitted(spark, p, t, targets)
        r = m.rates(p)
        assert (r >= 0).all() and not m.unmet()
        assert np.allclose((t * r) @ p / t.sum(), m.target, rtol=2e-4, atol=0)
        # Of all rates that meet the targets these are nearest to one: r - 1 is linear in the posterior where positive.
        inside = r > 0
        fit = np.linalg.lstsq(p[inside], r[inside] - 1, rcond=None)[0]
        assert np.allclose(p[inside] @ fit, r[inside] - 1, atol=1e-6)


def test_targets_out_of_reach_are_reported(spark, caplog):
    p = np.tile([0.75, 0.25], (50, 1))
    with caplog.at_level(logging.WARNING):
        m = fitted(spark, p, np.full(50, 10), {"d0": 0.5, "d1": 0.5})
    assert set(m.unmet()) == {"d0", "d1"} and "d1" in caplog.text
    assert np.isfinite(m.rates(p)).all()


def test_twelve_domains_with_halving_targets(spark):
    rng = np.random.default_rng(12)
    p = 0.997 * np.eye(12)[rng.integers(0, 12, 1200)] + 0.003 * rng.dirichlet(np.ones(12), 1200)
    t = rng.integers(50, 150, 1200)
    m = fitted(spark, p, t, {f"d{i}": 0.5**i for i in range(12)})
    assert not m.unmet() and m.distance() <= 1e-4


def test_number_of_domains_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_DOMAINS", 2)
    docs = spark.createDataFrame([(i, "some text") for i in range(3)], "doc_id long, text string")
    with pytest.raises(ValueError, match="domains"):
        mixing.mix(docs, docs.selectExpr("doc_id", "CAST(doc_id AS STRING) AS domain"))
