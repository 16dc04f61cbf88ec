"""The last earlier row whose value is near: a tree over values in place of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near(a: Column, b: Column, similarity: float) -> Column:
    """Whether two values differ by less than ``similarity`` of their mean, which is above 1e-9."""
    middle = (a + b) / 2
    return (middle > 1e-9) & (F.abs(a - b) / middle < similarity)


def _ranked(points: DataFrame, bounds: dict[str, tuple[Column, bool]]) -> tuple[DataFrame, DataFrame]:
    """(series_id, m, rank) of distinct values from 0, and points with the number of values below each bound (and at it, if told)."""
    values = points.select("series_id", F.col("m").alias("v"), F.lit(1).alias("tie"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("string").alias("name")).distinct()
    each = F.explode(F.array(*[F.struct(c.alias("v"), F.lit(2 if at else 0).alias("tie"), F.lit(k).alias("name")) for k, (c, at) in bounds.items()]))
    sought = points.select("series_id", "i", each.alias("x")).select("series_id", "x.v", "x.tie", "i", "x.name")
    so_far = Window.partitionBy("series_id").orderBy("v", "tie").rowsBetween(Window.unboundedPreceding, 0)
    met = values.unionByName(sought).withColumn("count", F.sum(F.when(F.col("tie") == 1, 1).otherwise(0)).over(so_far))
    ranks = met.where("tie = 1").select("series_id", F.col("v").alias("m"), (F.col("count") - 1).alias("rank"))
    counts = met.where("tie <> 1").groupBy("series_id", "i").agg(*[F.max(F.when(F.col("name") == k, F.col("count"))).alias(k) for k in bounds])
    return ranks, counts


def last_near(points: DataFrame, similarity: float) -> DataFrame:
    """(series_id, i, to): for each of (series_id, i, m) the largest smaller i with a near value; without one, no row.

    Only positive values can be near, and those near to one lie in an interval.  Values
    are ranked; a value belongs to one node of a binary tree over ranks at each level, and
    an interval is made of at most two nodes a level.  In a node the last earlier row is
    a running maximum, so n log n rows are sorted and nothing is paired.  Values so close
    to an end of the interval that rounding decides are compared one by one; there are at
    most some dozens of distinct doubles in that zone.

    A series' values meet in the sort that ranks them and in the topmost nodes.  Null,
    infinite and NaN values are near to nothing.  ``points`` is read several times.
    """
    if not 0 < similarity < 2:
        raise ValueError("similarity lies between 0 and 2")
    half = similarity / 2
    ratio, slack = (1 + half) / (1 - half), 16 * 2.0**-53 / (1 - half * half)
    points = points.where((F.col("m") > 0) & (F.col("m") < float("inf")))
    low, high = F.greatest(F.col("m") / ratio, F.lit(2e-9) - F.col("m")), F.col("m") * ratio
    ranks, counts = _ranked(points, {"wide_low": (low * (1 - slack), False), "low": (low * (1 + slack), False), "high": (high * (1 - slack), True), "wide_high": (high * (1 + slack), True)})
    depth = F.floor(F.log2((F.max("rank").over(Window.partitionBy("series_id")) + 1).cast("double"))).cast("int")
    leaves = points.join(ranks.withColumn("depth", depth), ["series_id", "m"])
    members = leaves.select("series_id", "i", "rank", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"))
    members = members.select("series_id", "level", F.expr("shiftright(rank, level)").alias("node"), "i", F.lit(True).alias("member"))

    inside = F.col("low") < F.col("high")
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.col("high").cast("double"))).cast("int"))
    spans = counts.where(inside).select("series_id", "i", "low", "high", F.explode(levels).alias("level"))
    spans = spans.select("series_id", "i", "level", F.expr("shiftright(low + shiftleft(1L, level) - 1, level)").alias("a"), F.expr("shiftright(high, level)").alias("b")).where("a < b")
    ends = F.array_compact(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)))
    asked = spans.select("series_id", "level", F.explode(ends).alias("node"), "i")

    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    zone = F.when(inside, F.concat(upto(F.col("wide_low"), F.col("low")), upto(F.col("high"), F.col("wide_high")))).otherwise(upto(F.col("wide_low"), F.col("wide_high")))
    doubtful = counts.select("series_id", "i", F.explode(zone).alias("rank")).join(ranks.withColumnRenamed("m", "other"), ["series_id", "rank"]).join(points, ["series_id", "i"])
    doubtful = doubtful.where(near(F.col("other"), F.col("m"), similarity)).select("series_id", F.lit(0).alias("level"), F.col("rank").alias("node"), "i")

    earlier = Window.partitionBy("series_id", "level", "node").orderBy("i", "member").rowsBetween(Window.unboundedPreceding, 0)
    both = members.unionByName(asked.unionByName(doubtful).withColumn("member", F.lit(False)))
    found = both.withColumn("to", F.max(F.when(F.col("member"), F.col("i"))).over(earlier)).where("NOT member AND to IS NOT NULL")
    return found.groupBy("series_id", "i").agg(F.max("to").alias("to"))
