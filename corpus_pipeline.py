"""The corpus pipeline: quality, language, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet
and read again as the next stage's documents.  All stages but the last return the
columns of documents with their values, whatever further columns there are and whatever
these are called.  An empty table gives an empty one at every stage; texts of any length
are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, packing, quality, simhash
from tidemark.llm.common import table, written
from tidemark.llm.queries import VOCABULARY


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; null, empty and blank texts go, repeated rows share their fate."""
    return quality.select_documents(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null or have no letter go, repeated rows share their fate."""
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id; rows without doc_id stay."""
    return simhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies (none to several) as bring the languages' tokens to tempered weights.

    Languages that are null are predicted like all others; repeated rows get the same number of copies.
    """
    return mixing.mixed_documents(docs, docs.select("doc_id", F.col("lang").alias("domain")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null text is empty, repeated rows are packed each."""
    return packing.pack(docs, VOCABULARY, end_id=2)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

# Learned models, connected components and token ids: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
