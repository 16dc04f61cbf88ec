"""Visibility over blocks of any size, with gaps and limits, against plain loops."""

import numpy as np
import pytest

from tidemark.operators import visibility


def brute(rows, kind, limit, penetrable):
    out = set()
    rows = [(t, v) for t, v in rows if v is not None]
    for a, (s, x) in enumerate(rows):
        for b in range(a + 1, len(rows)):
            d, y = rows[b]
            if limit is not None and d - s > limit:
                continue
            between = rows[a + 1 : b]
            if kind == "nvg":
                blocked = sum((v - x) / (t - s) >= (y - x) / (d - s) for t, v in between)
            else:
                blocked = sum(v >= min(x, y) for _, v in between)
            if blocked <= penetrable:
                out.add((s, d))
    return out


@pytest.mark.parametrize("kind", ["nvg", "hvg"])
@pytest.mark.parametrize("limit, penetrable", [(None, 0), (None, 2), (9, 0), (40, 1)])
def test_edges_match_loops(spark, monkeypatch, kind, limit, penetrable):
    monkeypatch.setattr(visibility, "CHUNK", 7)
    rng = np.random.default_rng(5)
    series = {"a": [(t + 1, float(v)) for t, v in enumerate(rng.integers(0, 9, 90))], "b": [(t * 13 + 1, None if t % 7 == 3 else float(v)) for t, v in enumerate(rng.normal(size=60))], "c": [(1, 2.0)]}
    df = spark.createDataFrame([(k, t, v) for k, r in series.items() for t, v in r], "series_id string, t long, value double")
    got = {}
    for r in visibility.visibility_edges(df, kind, limit, penetrable).collect():
        got.setdefault(r.series_id, set()).add((r.src, r.dst))
    for k, r in series.items():
        assert got.get(k, set()) == brute(r, kind, limit, penetrable), k


def test_watch_over_many_blocks():
    rng = np.random.default_rng(1)
    t, v = np.arange(1, 301), rng.normal(size=300)
    found = set()
    for lo in range(0, 300, 50):
        w = visibility.Watch(t[lo : lo + 50], v[lo : lo + 50], "nvg", None, 1)
        for at in range(lo, 300, 33):
            src, dst = w.pass_by(t[at : at + 33], v[at : at + 33])
            found |= set(zip(src.tolist(), dst.tolist()))
    assert found == brute(list(zip(t.tolist(), v.tolist())), "nvg", None, 1)


@pytest.mark.parametrize("kind", ["nvg", "hvg"])
@pytest.mark.parametrize("block, limit, penetrable, long", [(8, None, 0, False), (8, 30, 0, True), (16, None, 1, False), (1, None, 0, False), (5, 4, 0, False)])
def test_blocks_outlines_and_any_t(spark, monkeypatch, kind, block, limit, penetrable, long):
    monkeypatch.setattr(visibility, "BLOCK", block)
    rng = np.random.default_rng(7)
    series = {
        "negative": [(t - 50, float(v)) for t, v in enumerate(rng.integers(0, 5, 100))],
        "far": [(10**15 + 7 * t, float(v)) for t, v in enumerate(rng.normal(size=80))],
        "valley": [(t, float((t - 30) ** 2)) for t in range(60)],
        "flat": [(t, 1.0) for t in range(40)], "line": [(t, 0.1 * t) for t in range(40)],
        "holes": [(int(t), None if t % 5 == 0 else float(v)) for t, v in zip(np.cumsum(rng.integers(1, 40, 70)), rng.normal(size=70).cumsum())],
    }
    df = spark.createDataFrame([(k, t, v) for k, r in series.items() for t, v in r], "series_id string, t long, value double").repartition(3)
    got = {}
    for r in visibility.visibility_edges(df, kind, limit, penetrable, long=long).collect():
        got.setdefault(r.series_id, []).append((r.src, r.dst))
    for k, r in series.items():
        assert sorted(got.get(k, [])) == sorted(brute(r, kind, limit, penetrable)), k


def test_outlines_rule_blocks_out(spark, monkeypatch):
    """Of points that rise and fall at random only few visit later blocks."""
    monkeypatch.setattr(visibility, "BLOCK", 64)
    v = np.random.default_rng(3).normal(size=4000)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "series_id string, t long, value double")
    guests = []
    real = visibility._visitors
    monkeypatch.setattr(visibility, "_visitors", lambda *a: guests.append(real(*a)) or guests[0])
    edges = visibility.visibility_edges(df).count()
    assert guests[0].count() < edges and guests[0].count() < 4000 * 62 / 2 / 10


def test_outline_is_the_upper_hull():
    rng = np.random.default_rng(2)
    for _ in range(20):
        t, x = np.cumsum(rng.integers(1, 5, 50)), rng.normal(size=50)
        hull = visibility.outline(t, x, "nvg")
        line = np.interp(t, t[hull], x[hull])
        assert hull[0] == 0 and hull[-1] == 49 and (x <= line + 1e-9).all() and (np.diff(np.diff(x[hull]) / np.diff(t[hull])) < 1e-9).all()
