"""Tables written between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in ``spark.checkpoint.dir`` and read again: lineage ends here.

    In local mode a temporary folder is set where the session names none; on a cluster
    that is an error, as executors could not read it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-"))
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
