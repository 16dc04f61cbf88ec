import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import covertree, threshold

ROWS = "vec_id long, embedding array<float>, label int, v int, uid int"


def sample(n=300, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(0, n, 3):  # near and exact copies
        x[i] = x[(i * 7) % 40] + (rng.normal(size=dim) * 0.05 if i % 2 else 0)
    rows = [(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)]
    odd = [(n, None), (n + 1, [0.0] * dim), (n + 2, [math.nan] * dim), (n + 3, [math.inf] + [1.0] * (dim - 1))]
    odd += [(n + 4, [None] + [1.0] * (dim - 1)), (n + 5, [1.0, 2.0]), (n + 6, []), (0, x[0].tolist()), (20 * n, [1.0, 2.0])]
    return rows + [(i, v, 0, 1, 2) for i, v in odd]


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("block", [4096, 64])
def test_top_k_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(threshold, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(threshold, "QUERY_TEAM", 8)
    monkeypatch.setattr(threshold, "SPAN_BLOCKS", 2)
    rows = sample()
    df = spark.createDataFrame(rows, ROWS)
    got = sorted(tuple(r) for r in threshold.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())
    ints = [(i, [math.floor(64 * float(c)) for c in v]) for i, v, *_ in rows if usable(v)]
    want = []
    for a, (i, q) in enumerate(ints):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ints) if b != a and len(v) == len(q))
            want += [(i, k + 1, j, -s0) for k, (s0, j) in enumerate(s[:5])]
    assert got == sorted(want)


def test_lists_stop_early_and_stay_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (3000, 4)).astype(float)
    lists = threshold.SortedLists(x, np.arange(3000))
    shares = []
    for q in [*rng.integers(-9, 9, (40, 4)).astype(float), np.zeros(4)]:
        s = x @ q
        best = np.lexsort((np.arange(3000), -s))[:7]
        for least in (None, s[best[-1]], s[best[3]]):
            at, score, scored = lists.walk(q, 7, -1, least)
            want = best if least is None else best[s[best] >= least]
            assert lists.ids[at].tolist() == want.tolist() and (score == s[want]).all()
        shares.append(scored / 3000)
    assert min(shares) < 0.2 and max(shares[:-1]) < 1


def test_a_block_that_cannot_win_is_not_entered():
    lists = threshold.SortedLists(np.ones((50, 3)), np.arange(50))
    assert lists.walk(np.array([1.0, 1.0, 1.0]), 5, -1, 4.0)[2] == 0


def test_equal_scores_and_zero_queries(spark):
    rows = [(i, [0.5, -0.5]) for i in range(0, 60, 5)] + [(100, [0.0, 0.0]), (101, [0.0, 0.0])]
    got = threshold.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 4).collect()
    for q in (0, 20, 40, 100):
        ids = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert ids == ([x for x in range(0, 60, 5) if x != q][:4] if q < 100 else [0, 5, 10, 15])


@pytest.mark.parametrize("block", [4096, 50])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rows = sample()
    df = spark.createDataFrame(rows, ROWS)
    got = sorted(tuple(r) for r in covertree.near_vectors(df).collect())
    n = len(rows)
    ok = [usable(v) and any(v) for _, v, *_ in rows]
    link = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if ok[a] and ok[b] and len(x) == len(y):
                p, q = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                link[a][b] = link[b][a] = p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= 0.95
    want = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            u = todo.pop()
            for w in range(n):
                if link[u][w] and w not in seen:
                    seen.add(w)
                    todo.append(w)
        least = min(rows[w][0] for w in seen)
        want.append((rows[a][0], sum(link[a]), least, rows[a][0] == least))
    assert got == sorted(want)


@pytest.mark.parametrize("block", [7, 30])
def test_links_of_clusters_copies_and_visitors(spark, monkeypatch, block):
    """Tight clusters, a third of all rows one vector, cells of several parts and visitors in several turns."""
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "BATCHES", 1)
    monkeypatch.setattr(covertree, "MAX_PIVOTS", 9)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    x = np.vstack([centres[rng.integers(0, 6, 120)] + rng.normal(size=(120, 8)) * 0.16, np.tile(centres[0], (60, 1))]).astype(np.float32)
    got = {r.vec_id: r for r in covertree.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    d = x.astype(float)
    link = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1)) >= 0.95
    reach = link.copy()
    while (reach @ reach != reach).any():
        reach = reach @ reach
    assert len(got) == 180 and link.sum() > 4000
    for i in range(180):
        assert (got[i].n_links, got[i].component_id) == (link[i].sum() - 1, np.flatnonzero(reach[i])[0])


def test_far_cells_exchange_nothing(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 10)  # 24 pivots, so some on every side
    x = np.repeat(np.eye(4), 60, axis=0) + np.random.default_rng(0).normal(size=(240, 4)) * 0.02
    df = spark.createDataFrame([(i, 1, 4, v.tolist()) for i, v in enumerate(x)], "uid long, n long, dim int, v array<double>")
    cells = covertree._cells(df, 240, 0.95)
    assert cells.select("cell").distinct().count() > 1
    near = cells.groupBy(F.expr("cast(uid / 60 as int)").alias("side")).agg(F.collect_set("cell").alias("own"), F.flatten(F.collect_set("visits")).alias("seen")).collect()
    sides = {c: r.side for r in near for c in r.own}
    assert all(sides.get(c, r.side) == r.side for r in near for c in r.seen)


def test_cover_separates_and_covers():
    x = np.random.default_rng(1).normal(size=(500, 3)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for radius in (1.0, 0.5, 0.25):
        centres, owner = covertree.cover(x, radius, batch=64)
        gap = np.linalg.norm(x[centres][:, None] - x[centres][None], axis=2) + np.eye(len(centres)) * 9
        assert gap.min() > radius - 1e-3
        assert np.linalg.norm(x - x[owner], axis=1).max() <= radius + 1e-3


def test_empty_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert threshold.top_k(empty, F.col("vec_id") % 20 == 0).collect() == []
    assert covertree.near_vectors(empty).collect() == []
