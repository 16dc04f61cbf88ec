"""Communities and centralities of graphs against plain versions."""

import itertools
from collections import deque

import numpy as np
import pytest

from tidemark.operators import graphs

SCHEMA = "series_id string, src long, dst long, weight double"


def _adjacency(edges):
    nodes = sorted({n for e in edges for n in e[:2]})
    at = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for s, d, w in edges:
        a[at[s], at[d]] += w
        a[at[d], at[s]] += w
    return nodes, a


def _modularity(a, groups):
    k, m2 = a.sum(axis=1), a.sum()
    same = np.array(groups)[:, None] == np.array(groups)[None]
    return float(((a - np.outer(k, k) / m2) * same).sum() / m2)


def _best(a):
    """The largest modularity over all partitions."""

    def partitions(i, groups):
        if i == len(a):
            yield groups
            return
        for g in range(max(groups, default=-1) + 2):
            yield from partitions(i + 1, [*groups, g])

    return max(_modularity(a, g) for g in partitions(0, []))


def _random_edges(rng, n, p):
    return [(i, j, float(rng.integers(1, 4))) for i, j in itertools.combinations(range(n), 2) if rng.random() < p]


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(5)
    cliques = [(c * 6 + i, c * 6 + j, 1.0) for c in range(5) for i, j in itertools.combinations(range(6), 2)] + [(c * 6, (c * 6 + 7) % 30, 1.0) for c in range(5)]
    made = {"cliques": cliques, "pair": [(3, 9, 2.0)], **{f"r{i}": _random_edges(rng, 7, 0.45) for i in range(4)}, "big": _random_edges(rng, 24, 0.15)}
    rows = [(s, *e) for s, es in made.items() for e in es]
    odd = [("pair", 4, 4, 1.0), ("pair", None, 3, 1.0), ("pair", 5, 3, 0.0), ("pair", 5, 3, None), (None, 1, 2, 1.0)]
    return made, spark.createDataFrame(rows + odd, SCHEMA).cache()


def test_communities_raise_modularity(given):
    made, edges = given
    found = graphs.communities(edges)
    rows = {(r.series_id, r.node): r.community for r in found.collect()}
    known = {r.series_id: r for r in graphs.modularity(edges, found).collect()}
    for sid, es in made.items():
        nodes, a = _adjacency(es)
        groups = [rows[sid, n] for n in nodes]
        assert all(g == min(n for n, h in zip(nodes, groups) if h == g) for g in groups)
        assert known[sid].modularity == pytest.approx(_modularity(a, groups)) and known[sid].n_communities == len(set(groups))
        if len(nodes) <= 7:
            assert _modularity(a, groups) >= _best(a) - 0.06
    assert [rows["cliques", n] for n in range(30)] == [n // 6 * 6 for n in range(30)]
    assert rows["pair", 3] == rows["pair", 9] == 3 and len(rows) == sum(len(_adjacency(es)[0]) for es in made.values())


def _paths(a):
    n = len(a)
    d, sigma = np.full((n, n), np.inf), np.zeros((n, n))
    for s in range(n):
        d[s, s], sigma[s, s], queue = 0, 1, deque([s])
        while queue:
            v = queue.popleft()
            for w in np.flatnonzero(a[v]):
                if d[s, w] == np.inf:
                    d[s, w] = d[s, v] + 1
                    queue.append(w)
                if d[s, w] == d[s, v] + 1:
                    sigma[s, w] += sigma[s, v]
    return d, sigma


@pytest.mark.parametrize("passes", [1, 3])
def test_centralities_equal_plain_paths(given, passes):
    made, edges = given
    got = {(r.series_id, r.node): r for r in graphs.path_centralities(edges, passes).collect()}
    for sid, es in made.items():
        nodes, a = _adjacency(es)
        d, sigma = _paths(a)
        for i, node in enumerate(nodes):
            others = [j for j in range(len(nodes)) if j != i and d[i, j] < np.inf]
            through = sum(sigma[s, i] * sigma[i, t] / sigma[s, t] for s, t in itertools.combinations(others, 2) if d[s, i] + d[i, t] == d[s, t])
            r = got[sid, node]
            assert r.reached == len(others) and r.closeness == pytest.approx(len(others) / sum(d[i, j] for j in others))
            assert r.harmonic == pytest.approx(sum(1 / d[i, j] for j in others)) and r.betweenness == pytest.approx(through)
    assert len(got) == sum(len(_adjacency(es)[0]) for es in made.values())


def test_clustering_counts_triangles(given):
    made, edges = given
    got = {(r.series_id, r.node): r for r in graphs.clustering(edges).collect()}
    for sid, es in made.items():
        nodes, a = _adjacency(es)
        b = (a > 0).astype(int)
        for i, node in enumerate(nodes):
            r, k, t = got[sid, node], b[i].sum(), (b @ b @ b)[i, i] // 2
            assert (r.degree, r.triangles) == (k, t) and (r.clustering is None if k < 2 else r.clustering == pytest.approx(2 * t / (k * (k - 1))))


def test_no_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert graphs.communities(none).isEmpty() and graphs.path_centralities(none).isEmpty() and graphs.clustering(none).isEmpty()
    with pytest.raises(ValueError):
        graphs.path_centralities(none, 0)


def _rows(df):
    return sorted(df.collect())


def test_small_graphs_are_searched_within_few_stages(given, monkeypatch):
    _, edges = given
    monkeypatch.setattr(graphs, "_from_sources", None)  # the levels of joins, which took a job each for all graphs
    assert not graphs.path_centralities(edges).isEmpty()


def test_large_graphs_have_the_same_centralities(given, monkeypatch):
    _, edges = given
    one = _rows(graphs.path_centralities(edges))
    monkeypatch.setattr(graphs, "SMALL_NODES", 7)  # the larger graphs go level by level
    for a, b in zip(one, _rows(graphs.path_centralities(edges)), strict=True):
        assert tuple(a)[:3] == tuple(b)[:3] and tuple(a)[3:] == pytest.approx(tuple(b)[3:])


def test_small_graphs_make_their_rounds_without_jobs(given, monkeypatch):
    _, edges = given
    monkeypatch.setattr(graphs, "_settled", None)  # rounds of joins, some dozens of jobs for all graphs
    assert not graphs.communities(edges).isEmpty()


def test_large_graphs_have_the_same_communities(given, monkeypatch):
    _, edges = given
    one = _rows(graphs.communities(edges))
    monkeypatch.setattr(graphs, "SMALL_NODES", 7)
    assert one == _rows(graphs.communities(edges))
