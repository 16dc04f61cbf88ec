"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode, where all run on one machine, a temporary folder is set if the session
    names none; on a cluster that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context_dir.isDefined():
            known = context_dir.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            known = tempfile.mkdtemp(prefix="tidemark-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ... (which no added name can meet), and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unmasked(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that ``masked`` renamed, under their own names; what was added is left out."""
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


HEAVY_SHARE, HEAVY_ROWS = 10_000, 1_000


def join_uneven(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a ``key`` and in ``size`` that key's number of ``rows``.

    Keys of more than a HEAVY_SHARE-th of the ``total`` rows (so fewer than HEAVY_SHARE
    keys, however much data there is) are joined by broadcast, so that no task gets them
    whole; all others are shuffled.  Rows whose key ``table`` lacks are dropped.
    """
    heavy = table.where(F.col(size) > max(HEAVY_ROWS, total // HEAVY_SHARE))
    if heavy.isEmpty():
        return rows.join(table.drop(size), key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.drop(size), key)
    return rows.join(F.broadcast(heavy.drop(size)), key).unionByName(light)


def top_k_threshold(scores: DataFrame, column: str, k: int, bins: int = 2048, few: int = 20_000) -> float | None:
    """The ``k``-th largest value of a double column, exactly, in a few histogram passes.

    Each pass counts the rows of ``bins`` equal slices of the interval that still holds
    the k-th value and goes on in one of them; at most ``few`` values reach the driver.
    None if there are fewer than ``k`` values; nulls and NaN take no part.
    """
    values = scores.select(F.col(column).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    lo, hi, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k < 1 or n < k:
        return None
    above = 0
    while n > few and hi > lo:
        step = (hi - lo) / bins
        inside = values.where((F.col("v") >= lo) & (F.col("v") <= hi))
        slot = F.least(F.floor((F.col("v") - lo) / step), F.lit(bins - 1)).alias("slot")
        counted = inside.groupBy(slot).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for row in sorted(counted, key=lambda r: -r["slot"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if (row["lo"], row["hi"]) == (lo, hi):
            break
        lo, hi, n = row["lo"], row["hi"], row["n"]
    if hi == lo:
        return lo
    inside = values.where((F.col("v") >= lo) & (F.col("v") <= hi)).collect()
    return sorted((r["v"] for r in inside), reverse=True)[k - above - 1]
