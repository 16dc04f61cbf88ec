"""Generated series, the same at every run and on any number of partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_steps(spark: SparkSession, n: int = 861, series_id: str = "walker") -> DataFrame:
    """(series_id, t, value): a weekly and a quarterly wave, like a step counter's."""
    t = F.col("id") + 1
    value = 5000 + 2500 * F.sin(t * (2 * math.pi / 7)) + 1500 * F.sin(t * (2 * math.pi / 90))
    return spark.range(n).select(F.lit(series_id).alias("series_id"), t.alias("t"), value.alias("value"))


def panel(spark: SparkSession, users: int = 20, n: int = 100) -> DataFrame:
    """(user, t, pleasure, arousal): several users' ratings between 0 and 100."""
    u, t = F.floor(F.col("id") / n), F.col("id") % n + 1
    noise = lambda a, b: (u * a + t * b) % 101
    wave = 50 + 20 * F.sin(t * (2 * math.pi / 25) + u)
    rating = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(100.0), wave + (noise(a, b) - 50) * 0.4))
    return spark.range(users * n).select(F.concat(F.lit("u"), u.cast("string")).alias("user"), t.alias("t"), rating(37, 61).alias("pleasure"), rating(53, 29).alias("arousal"))


def random_walk(spark: SparkSession, n: int = 500, breaks: tuple[int, int] = (0, 0), factor: float = 2.0) -> DataFrame:
    """(series_id, t, value): the running sum of even steps of a fixed sequence, ``factor`` times as wide between the two breaks."""
    from pyspark.sql import Window

    t = F.col("id") + 1
    step = (t * 7919 % 1009) / 1009 - 0.5
    step = F.when((t > breaks[0]) & (t <= breaks[1]), step * factor).otherwise(step)
    rows = spark.range(n).select(F.lit("walk").alias("series_id"), t.alias("t"), step.alias("_s"))
    return rows.withColumn("value", F.sum("_s").over(Window.partitionBy("series_id").orderBy("t"))).drop("_s")
