"""Ward linkage of many series at once against each by itself."""

import numpy as np
import pytest

from tidemark.operators import clustering, discretize


@pytest.mark.parametrize("n", [3, 4, 17, 40])
def test_labels_are_those_of_each_series(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(9, n, 4)), 1)
    x[3], x[4] = 0.0, np.repeat(x[4, :1], n, axis=0)
    got = clustering.ward_labels_of_many(x, 3)
    assert all((got[i] == clustering.ward_labels(x[i], 3)).all() for i in range(len(x)))


def test_states_do_not_depend_on_how_many_are_linked_at_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", t + 1, float(v)) for i in range(12) for t, v in enumerate(rng.normal(size=5 + 4 * i))]
    series = spark.createDataFrame(rows, "series_id string, t long, value double")
    states = lambda: {(r.series_id, r.t): r.state for r in discretize.discretize(series, "proxy_windowed", 3, window=5, step=2).collect()}
    together = states()
    monkeypatch.setattr(clustering, "FEW_WINDOWS", 0)
    assert together == states() and len(together) == len(rows)
