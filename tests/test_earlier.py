"""The last earlier near value, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import regime
from tidemark.operators.earlier import last_near

S = "series_id string, i long, m double"


def brute(rows, similarity):
    out = {}
    for k, j, b in rows:
        before = [i for q, i, a in rows if q == k and i < j and a is not None and b is not None and (a + b) / 2 > 1e-9 and abs(a - b) / ((a + b) / 2) < similarity]
        if before:
            out[k, j] = max(before)
    return out


@pytest.mark.parametrize("similarity", [1e-16, 0.05, 0.6, 1.5])
def test_against_all_pairs(spark, similarity):
    r = random.Random(7)
    whole = [("whole", i, float(r.randint(-2, 60))) for i in range(150)]  # many ties, and ratios that lie just at the end
    wide = [("wide", i, 10 ** r.uniform(-12, 12)) for i in range(150)]
    tiny = [("tiny", i, r.choice([0.0, 3e-10, 5e-10, 1e-9, 1.5e-9, 2e-9, 2.0000000001e-9, 4e-9])) for i in range(40)]
    close = [("close", i, 0.1 + r.choice([0.0, 0.2, 1e-17, 3e-17]) * r.choice([1, 3])) for i in range(40)]
    odd = [("odd", 1, None), ("odd", 2, 5.0), ("odd", 3, float("nan")), ("odd", 4, float("inf")), ("odd", 5, -5.0), ("odd", 6, 5.0), ("one", 1, 2.0)]
    rows = whole + wide + tiny + close + odd
    got = {(x.series_id, x.i): x.to for x in last_near(spark.createDataFrame(rows, S), similarity).collect()}
    assert got == brute(rows, similarity)


def test_ends_of_the_interval(spark):
    """Pairs of whole numbers whose difference is exactly the share asked for are not near."""
    rows = [(str(n), i, float(v)) for n in range(1, 30) for i, v in enumerate((7 * n, 13 * n))]
    assert last_near(spark.createDataFrame(rows, S), 0.6).count() == len(brute(rows, 0.6))


def test_no_pairs_in_the_plan(spark):
    plan = last_near(spark.range(100).select(F.lit("a").alias("series_id"), F.col("id").alias("i"), F.rand(1).alias("m")), 0.6)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString() and "Cross" not in text


def test_similarity_out_of_range_and_no_rows(spark):
    none = spark.createDataFrame([], S)
    assert last_near(none, 0.6).count() == 0
    for wrong in (0, 2, -1.0):
        with pytest.raises(ValueError):
            last_near(none, wrong)


def test_consolidated_against_a_loop(spark):
    r = random.Random(3)
    x = [r.choice([1.0, 2.0, 5.0, 11.0, 40.0]) * r.uniform(0.9, 1.1) for _ in range(60) for _ in range(1)]
    rows = [("a", 5 * n + k, x[n], n + 1) for n in range(60) for k in range(5)]
    found = spark.createDataFrame(rows, "series_id string, t long, complexity double, regime_id long").selectExpr("*", "false AS regime_change", "1L AS min_size")
    got = [v.regime_id for v in regime.consolidate(found, 0.4).orderBy("t").collect()]
    to = brute([("a", n + 1, x[n]) for n in range(60)], 0.4)
    mapped = [to.get(("a", n + 1), n + 1) for n in range(60)]
    changes = [n > 0 and mapped[n] != mapped[n - 1] for n in range(60)]
    want, at = [], 1
    for n in range(60):
        at += changes[n]
        want += [at] * 5
    assert got == want
