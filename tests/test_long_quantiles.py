"""Summaries, similarities, networks and scalers give the same with quantiles by range partitions."""

import random

import pytest

from tidemark.operators import proximity, scaling


@pytest.fixture(scope="module")
def pairs(spark):
    """A hot series, a small one, one of equal distances, one of zeros, nulls and infinities."""
    r = random.Random(6)
    rows = [("hot", i, j, r.choice([0.0, 1.0, 2.5, r.uniform(0, 900)])) for i in range(40) for j in range(i)]
    rows += [("few", 1, 2, 3.0), ("few", 1, 3, 4.0), ("few", 2, 3, 0.5), ("same", 1, 2, 7.0), ("same", 1, 3, 7.0), ("odd", 1, 2, None), ("odd", 1, 3, float("inf")), ("odd", 2, 3, 2.0), ("zero", 1, 2, 0.0)]
    return spark.createDataFrame(rows, "series_id string, src long, dst long, distance double").repartition(5)


def same(make):
    show = lambda d: sorted((tuple(str(round(x, 9)) if isinstance(x, float) else x for x in r) for r in d.select(sorted(d.columns)).collect()), key=str)
    got, want = show(make(True)), show(make(False))
    assert len(want) > 0 and got == want


def test_pairs(pairs):
    same(lambda long: proximity.distance_summary(pairs, long))
    same(lambda long: proximity.recommend(pairs, long))
    for m in ("gaussian", "negative_exp"):
        same(lambda long, m=m: proximity.similarity(pairs, m, long=long))
    for m in ("threshold", "percentile", "gaussian"):
        same(lambda long, m=m: proximity.build_network(pairs, m, long=long))
    for m in ("robust", "quantile"):
        same(lambda long, m=m: proximity.prepare_plot(pairs, "inverse", m, cut=0.3, long=long))


def test_scalers(pairs):
    series = pairs.selectExpr("series_id", "40 * src + dst AS t", "CASE WHEN distance < 1e9 THEN distance END AS value")
    for m in ("iqr", "robust", "quantile", "minmax"):
        same(lambda long, m=m: scaling.scaling_parameters(series, m, long=long))
        same(lambda long, m=m: scaling.apply_scaling(series, m, long=long))
