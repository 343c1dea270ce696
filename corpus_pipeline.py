"""The corpus pipeline: quality classifier, near-dedup, mixing to target weights, packing.

Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table; other columns than those of
``documents`` pass through unread.  Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.  Part of the ``llm``
subpackage in all but place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm import mixing, near_dedup, packing, quality
from verisieve.llm.common import materialize
from verisieve.llm.queries import QUALITY_FROM, quality_chain, tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line classifier rejects.  Rows are judged by their texts alone, null texts as empty ones."""
    chain = quality_chain(spark, docs, sf_dir)
    return docs.withColumn("__score", quality.score(chain, F.col("text"))).where(F.col("__score") >= QUALITY_FROM).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id, ids before none.

    Groups are of rows, not of ids: a null id, a repeated row or an id with several texts is judged by its text alone.  Rows without
    words are linked with nothing and all stay.
    """
    held = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    found = near_dedup.near_duplicates(held, percent=80, key="__row").select(F.col("__row").alias("__r"), "component_id")
    names = held.select("__row", F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"))
    first = F.min(F.struct("none", "doc_id", "h", "__row")).alias("k")
    kept = names.join(found, F.col("__row") == F.col("__r")).groupBy("component_id").agg(first).select(F.col("k.__row").alias("__row"))
    return held.join(kept, "__row", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; a document taken twice comes twice, one without words does not come."""
    return mixing.mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences.  A null text is the end token alone; equal rows are separate."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality classifier", keep_good), ("near-dedup", keep_one_of_each), ("mixing", mix_sources), ("packing", pack_tokens)]

#: SQL can express none of the stages; tests hold them against brute force and invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
