"""k-means runs until it settles."""

import numpy as np

from tidemark.operators import discretize


def test_states_are_those_of_settled_centres(spark):
    rng = np.random.default_rng(4)
    series = {"skewed": np.round(rng.lognormal(0, 1.5, 400), 4), "short": np.round(rng.normal(size=12), 4)}
    rows = [(sid, i, float(v)) for sid, x in series.items() for i, v in enumerate(x)] + [("short", 99, None), ("flat", 1, 2.0)]
    s = spark.createDataFrame(rows, "series_id string, t long, value double")
    got = {(r.series_id, r.t): r.state for r in discretize.discretize(s, "kmeans", 3).collect()}
    assert len(got) == len(rows) and got["short", 99] is None and got["flat", 1] is None
    most = 0
    for sid, x in series.items():
        c, steps = np.round(np.quantile(x, [1 / 6, 3 / 6, 5 / 6]), 10), 0
        while True:
            at = ((c[1:] + c[:-1])[None] / 2 < x[:, None]).sum(axis=1)
            new, steps = np.array([x[at == j].mean() for j in range(3)]), steps + 1
            if np.allclose(new, c, rtol=1e-14, atol=0):
                break
            c = new
        most = max(most, steps)
        assert [got[sid, i] for i in range(len(x))] == (at + 1).tolist()
    assert most > 9
