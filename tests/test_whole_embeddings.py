"""Pairs of embeddings of every label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import proximity
from tidemark.plans.queries import QUERIES
from tidemark.plans.registry import r6, r6_of_many


def test_pairs_of_all_labels(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(30, 64)).astype(np.float32)
    label = [i % 4 for i in range(28)] + [None, 7]
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.src, r.dst): r.distance for r in QUERIES["dist_embeddings"](spark, str(tmp_path)).collect()}
    want = {(i, j): np.linalg.norm(x[i].astype(float) - x[j]) for i in range(28) for j in range(i + 1, 28) if label[i] == label[j]}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=2e-7) for k, v in want.items())


def test_blocks_give_the_rows_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [("a" if i % 3 else "b", i, [float(v) for v in rng.normal(size=5)]) for i in range(40)]
    rows += [("a", 50, None), ("b", 51, [1.0, None, 0.0, 0.0, 0.0]), ("b", 52, [float("nan")] * 5), ("one", 53, [0.0] * 5), (None, 54, [0.0] * 5), (None, 55, [0.0] * 5)]
    vectors = spark.createDataFrame(rows, "series_id string, window_id long, x array<double>").repartition(3)
    want = sorted(map(repr, proximity.pairwise(vectors).where("series_id IS NOT NULL").collect()))
    for block in (4, 1024):
        assert sorted(map(repr, proximity.pairwise_by_blocks(vectors, block).collect())) == want
    uneven = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [1.0, 2.0])], "series_id string, window_id long, x array<double>")
    with pytest.raises(Exception, match="differ in length"):
        proximity.pairwise_by_blocks(uneven).collect()


def test_vectors_of_one_label_meet_in_many_tasks_without_copies_on_disk(spark, tmp_path):
    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    rng = np.random.default_rng(8)
    rows = [("a", i, [float(v) for v in rng.normal(size=64)]) for i in range(256)]
    vectors = spark.createDataFrame(rows, "series_id string, window_id long, x array<double>")
    assert proximity.pairwise_by_blocks(vectors, 8).select(F.spark_partition_id()).distinct().count() > 16
    vectors.write.parquet(f"{tmp_path}/vectors")
    wrote = []
    for block in (256, 8):
        before = shuffled()
        assert proximity.pairwise_by_blocks(spark.read.parquet(f"{tmp_path}/vectors"), block).count() == 256 * 255 // 2
        wrote.append(shuffled() - before)
    assert wrote[1] < 3 * wrote[0]


def test_blocks_leave_out_vectors_without_an_id(spark):
    rows = [("a", 1, [0.0]), ("a", None, [1.0]), ("a", 2, [2.0]), ("a", 2, [5.0]), ("b", None, None), ("c", 1, None), ("c", 2, None)]
    vectors = spark.createDataFrame(rows, "series_id string, window_id long, x array<float>")
    for block in (1, 1024):
        got = proximity.pairwise_by_blocks(vectors, block)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, proximity.pairwise(vectors).collect()))
        assert sorted(map(repr, proximity.pairwise_by_blocks(vectors, block, named=False).collect())) == sorted(map(repr, got.drop("series_id").collect()))


def test_rounding_of_many_is_that_of_few(spark):
    values = [0.0, 1e-9, 0.12345675, 2.5, 1.7667624123, 99.99999995, 3e8, 1e300, -0.25, -1.00000005, float("inf"), float("-inf"), float("nan"), None]
    d = spark.createDataFrame([(v,) for v in values], "distance double").coalesce(1)
    got = d.select(r6_of_many("distance", 7), r6("distance", "few", 7)).collect()
    assert all(repr(r[0]) == repr(r[1]) for r in got)


def test_lengths_are_compared_between_blocks(spark):
    for x in ([1.0, 2.0], [None, 2.0], []):
        vectors = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, x), ("a", 3, None)], "series_id string, window_id long, x array<float>")
        with pytest.raises(Exception, match="differ in length"):
            proximity.pairwise_by_blocks(vectors, 1).collect()
