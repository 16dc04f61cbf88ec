"""Synchronous events and filtered trains, and their surrogates, against plain versions."""

import numpy as np
import pytest

from tidemark.operators import proximity

PLACES = {"a": 0.7548776662466927, "g": 0.5698402909980532}


def _copies(a, reach, surrogates):
    z = np.arange(1, len(a) + 1) * PLACES["a"]
    return [np.sort(a) + ((z + g * PLACES["g"]) % 1 * 2 - 1) * reach for g in range(1, surrogates + 1)]


@pytest.fixture(scope="module")
def trains(spark):
    rng = np.random.default_rng(8)
    made = {"long": (np.sort(rng.integers(-400, 900, 150)) * 1.0, np.sort(rng.integers(-400, 900, 90)) + 0.3), "same": (np.array([1.0, 4.0, 4.0]), np.array([1.0, 4.0, 4.0])),
            "edge": (np.array([255.0, 256.0, 512.0]), np.array([257.0, 511.0])), "far": (np.array([0.0]), np.array([5000.0]))}
    one = {"only_a": (np.array([3.0]), np.array([])), "only_b": (np.array([]), np.array([3.0]))}
    frame = lambda side: spark.createDataFrame([(s, float(x)) for s, ab in (made | one).items() for x in ab[side]], "series_id string, at double")
    return made, frame(0), frame(1)


def _es(a, b, tau):
    near = np.abs(a[:, None] - b) <= tau
    return (near.any(1).mean() + near.any(0).mean()) / 2


def test_synchronous_events_equal_all_pairs(trains):
    made, a, b = trains
    got = {r.series_id: r.es for r in proximity.event_synchronisation(a, b, 1.0).collect()}
    assert got == {s: pytest.approx(_es(*ab, 1.0)) for s, ab in made.items()}


def test_significance_of_synchrony_holds_no_table_in_the_driver(trains):
    made, a, b = trains
    found = proximity.synchronisation_significance(a, b, 1.0, surrogates=7)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.series_id: (r.es, r.p_value) for r in found.collect()}
    for s, (x, y) in made.items():
        own, copies = _es(x, y, 1.0), [_es(c, y, 1.0) for c in _copies(x, 5.0, 7)]
        assert got.pop(s) == pytest.approx((own, np.mean([round(c, 12) >= round(own, 12) for c in copies])))
    assert not got


def _far(a, b, tau, lo, hi):
    x = lo + np.arange(np.floor((hi - lo) / (tau / 10)) + 1) * (tau / 10)
    part = lambda at: (np.where(x[:, None] >= at, np.exp(-np.maximum(x[:, None] - at, 0) / tau), 0)).sum(1)
    return np.sqrt(((part(a) - part(b)) ** 2).sum() / 10)


def test_filtered_distances_make_no_row_of_a_grid_point(trains):
    made, a, b = trains
    found = proximity.van_rossum_significance(a, b, 2.0, surrogates=7)
    assert "sequence" not in found.drop("p_value")._jdf.queryExecution().optimizedPlan().toString().replace("sequence(0, 7", "")
    got = {r.series_id: (r.distance, r.p_value) for r in found.collect()}
    own = {r.series_id: r.distance for r in proximity.van_rossum(a, b, 2.0).collect()}
    assert set(got) == set(own) == {*made, "only_a", "only_b"}
    for s, (x, y) in made.items():
        both = np.concatenate([x, y])
        far = lambda c, lo=both.min(), hi=both.max() + 10, y=y: _far(c, y, 2.0, lo, hi)
        copies = [far(c) for c in _copies(x, 10.0, 7)]
        assert got[s] == pytest.approx((far(x), np.mean([round(c, 9) <= round(far(x), 9) for c in copies])), abs=1e-9) and own[s] == pytest.approx(far(x), abs=1e-9)
