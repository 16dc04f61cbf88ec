"""Networks by the index of piecewise means against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import proximity


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 10)) for c in (0.0, 5.0, -40.0)]).round(1)
    x[5] = x[6]  # a distance of zero
    rows = [("a", i + 1, v.tolist()) for i, v in enumerate(x)] + [("b", i + 1, v.tolist()) for i, v in enumerate(x[:4])] + [("c", 1, [1.0] * 10), ("a", 999, [None] + [1.0] * 9)]
    return spark.createDataFrame(rows, "series_id string, window_id long, x array<double>").repartition(3)


def rows(network):
    return sorted((r.series_id, r.src, r.dst, round(r.weight, 12)) for r in network.collect())


@pytest.mark.parametrize("k", [1, 3, 70])
def test_nearest(vectors, k):
    assert rows(proximity.indexed_network(vectors, "knn", k)) == rows(proximity.build_network(proximity.pairwise(vectors), "knn", k))


@pytest.mark.parametrize("epsilon", [0.7, 1.5, 30.0])
def test_epsilon(vectors, epsilon):
    assert rows(proximity.indexed_network(vectors, "epsilon", epsilon=epsilon)) == rows(proximity.build_network(proximity.pairwise(vectors), "epsilon", epsilon=epsilon))


def test_bound_and_pairs_left_out(vectors):
    p = proximity.indexed(vectors)
    a, b = p.select("series_id", F.col("window_id").alias("i"), "x", "u"), p.select("series_id", F.col("window_id").alias("j"), F.col("x").alias("y"), F.col("u").alias("v"))
    d = proximity.metric("euclidean")
    both = a.join(b, "series_id").select(d(F.col("x"), F.col("y")).alias("d"), d(F.col("u"), F.col("v")).alias("least"))
    assert both.where("least > d + 1e-9").count() == 0
    assert both.where("least <= 1.0").count() < both.count() / 2.5
    with pytest.raises(ValueError):
        proximity.indexed_network(vectors, "full")


def test_infinite_and_normalized(spark):
    inf = float("inf")
    e = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 1, 3, 4.0), ("a", 2, 3, inf)], "series_id string, src long, dst long, distance double")
    got = {(r.src, r.dst): r.weight for r in proximity.build_network(e, "epsilon", epsilon=0.5, normalized=True).collect()}
    assert got == {(1, 2): pytest.approx(1 / 1.025), (1, 3): pytest.approx(1 / 1.1)}
    assert {(r.src, r.dst): r.weight for r in proximity.build_network(e, "knn", k=2).collect()}[2, 3] == pytest.approx(1 / 41)


def test_nothing(vectors):
    assert proximity.indexed_network(vectors.limit(0), "knn").count() == 0 == proximity.indexed_network(vectors.limit(0), "epsilon", epsilon=1.0).count()
