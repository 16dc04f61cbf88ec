"""The maximal information coefficient against all ways to cut an axis."""

import itertools

import numpy as np
import pytest

from tidemark.operators import information, proximity


def _mutual(u, v):
    n, total = len(u), 0.0
    for a in set(u):
        for b in set(v):
            c = sum((p, q) == (a, b) for p, q in zip(u, v))
            if c:
                total += c / n * np.log(c * n / (list(u).count(a) * list(v).count(b)))
    return total


def _every_cut(x, y, cells):
    """The largest normalised information over even rows of y and all cuts of x, and the same turned."""
    best = 0.0
    for s, other in ((x, y), (y, x)):
        ranks = [sum(w < v for w in other) for v in other]
        between = sorted(set(s))[:-1]
        for rows in range(2, cells // 2 + 1):
            v = [r * rows // len(s) for r in ranks]
            for columns in range(2, cells // rows + 1):
                for cuts in itertools.combinations(between, min(columns - 1, len(between))):
                    best = max(best, _mutual([sum(c < w for c in cuts) for w in s], v) / np.log(min(columns, rows)))
    return best


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(11)
    made = {f"r{i}": (rng.integers(0, 9, 12).astype(float), rng.integers(0, 9, 12).astype(float)) for i in range(4)}
    x = np.arange(12.0)
    made |= {"square": (x, (x - 5) ** 2), "line": (x, 3 * x), "flat": (x, x * 0), "four": (x[:4], x[:4] % 2)}
    rows = [(sid, i, float(p), float(q)) for sid, (u, v) in made.items() for i, (p, q) in enumerate(zip(u, v))]
    rows += [("line", 90, None, 1.0), ("line", 91, 1.0, None), ("line", 92, float("nan"), 1.0), ("few", 1, 1.0, 2.0), ("few", 2, 2.0, 3.0)]
    both = spark.createDataFrame(rows, "series_id string, t long, value double, other double")
    return made, both.select("series_id", "t", "value"), both.selectExpr("series_id", "t", "other as value")


def test_equals_all_cuts(sides):
    made, a, b = sides
    got = {r.series_id: r.mic for r in information.optimal_information(a, b, 0.95, clumps=None).collect()}
    assert set(got) == set(made)
    for sid, (x, y) in made.items():
        assert got[sid] == pytest.approx(_every_cut(list(x), list(y), max(4, int(len(x) ** 0.95))), abs=1e-12)
    assert got["line"] == pytest.approx(1) and got["flat"] == 0


def test_never_below_even_grids(sides, spark):
    _, a, b = sides
    even = {r.series_id: r.mic for r in proximity.maximal_information(a, b).collect()}
    best = {r.series_id: r.mic for r in information.optimal_information(a, b, clumps=None).collect()}
    assert all(best[s] >= even[s] - 1e-12 for s in best)


def test_joined_clumps_lose_little():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=500)
    row = information.even_rows(np.sin(9 * x) + rng.normal(size=500) * 0.3, 4)
    free, joined = (information.best_columns(x, row, 6, c) for c in (None, 5))
    assert all(f >= j - 1e-12 for f, j in zip(free, joined)) and joined[-1] > 0.9 * free[-1] and free == sorted(free)
