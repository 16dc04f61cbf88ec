"""One long series in ranges gives what it gives whole."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import regime, rolling
from tidemark.sources import ranges, series


@pytest.fixture(scope="module")
def long(spark):
    """A series of 800 rows with gaps in t and two short ones."""
    r = random.Random(4)
    rows = [("long", 3 * i - 40 + r.randint(0, 1), r.choice([0.0, 0.1, 3.0]) + r.random() * (5 if i % 300 < 150 else 1)) for i in range(800)]
    rows += [("one", 5, 1.0)] + [("few", i, float(i % 3)) for i in range(30)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "series_id string, t long, value double").repartition(5)


def same(a, b, digits=9):
    show = lambda d: sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in d.select(sorted(d.columns)).collect()), key=str)
    assert sorted(a.columns) == sorted(b.columns)
    got, want = show(a), show(b)
    assert len(got) == len(want) and got == want


def test_numbers_and_quantiles(long):
    got = ranges.numbered(long, ["series_id"], ["t"], "i")
    same(got, ranges.Whole().rows(long).withColumn("i", F.col("_i").cast("long")).drop("_i"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for value in (F.col("value"), F.round("value")):
        some = long.withColumn("v", F.when(F.col("t") % 7 != 0, value))
        want = some.groupBy("series_id").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).where("q IS NOT NULL")
        same(ranges.group_quantiles(some, "v", probs).select("series_id", F.explode("q")), want.select("series_id", F.explode("q")), 12)


@pytest.mark.parametrize("rescale", [False, True])
def test_rolling(long, rescale):
    some = long.withColumn("value", F.when(F.col("t") % 11 != 0, F.col("value")))
    same(rolling.rolling_measures(some, width=7, rescale=rescale, block=100), rolling.rolling_measures(some, width=7, rescale=rescale))
    same(rolling.rolling_measures(some, width=7, block=3), rolling.rolling_measures(some, width=7))  # frames over several blocks


@pytest.mark.parametrize("method", ["smart", "all", "threshold", "entropy"])
def test_regimes(long, method):
    same(regime.detect_changes(long, method, block=100), regime.detect_changes(long, method))


def test_gaps_and_whole_regimes(long):
    some = long.withColumn("value", F.when((F.col("t") % 5 != 0) & ~F.col("t").between(300, 900), F.col("value")))
    same(series.fill_gaps(some, 100), series.fill_gaps(some))
    same(regime.detect_regime(some, block=100), regime.detect_regime(some))
    same(regime.detect_regime(some, block=100, consolidate_similar=True), regime.detect_regime(some, consolidate_similar=True))


def test_no_task_holds_the_series(long, spark):
    before = ranges.Ranges(100).rows(long, 6, 6)
    assert before.groupBy("series_id", "_block").count().agg(F.max("count")).first()[0] <= 112
    plan = ranges.Ranges(100).totals(before, {"_n": F.count("*")})._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "series_id string, t long, value double")
    assert regime.detect_regime(none, block=10).count() == 0 and rolling.rolling_measures(none, block=10).count() == 0


def test_smart_regimes_of_ranges_sort_no_values_and_leave_scans(long, monkeypatch):
    """No quantile is taken that no detector in use compares, and rows with carried values are a scan and a small table."""
    want = regime.detect_regime(long)
    monkeypatch.setattr(ranges, "group_quantiles", lambda *_: pytest.fail("quantiles without use"))
    same(regime.detect_regime(long, block=100), want)
    within = ranges.Ranges(100)
    carried = within.before(within.rows(long), {"_top": F.col("value")})
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    same(carried.drop("_block").withColumn("_i", F.col("_i").cast("int")), ranges.Whole().before(ranges.Whole().rows(long), {"_top": F.col("value")}))
