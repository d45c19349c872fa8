"""A corpus pipeline of five operators: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pataspark.llm import decontaminate, minhash, mixing, sharding, toxicity
from pataspark.llm.common import shared_table, text_or_empty, words_of


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null and empty texts are scored like others; repeated rows are scored alike and all stay or go. An empty table gives no rows.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return toxicity.scored(docs, model).filter("predicted = 0").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id (null last); of repeated rows, the least.

    A document is a doc_id with one text, so different texts of one id are compared like those of different ids. Rows without
    doc_id are grouped by their texts too; without words as well, they are like nothing and stay.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))
    stay = F.col("doc_id").isNull() & (F.size(words_of(text_or_empty())) == 0)
    found = docs.filter(~stay).withColumn("_key", key)
    ids = found.select("_key", "doc_id").distinct()
    groups = minhash.near_duplicates(found.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key"))
    kept = shared_table(groups.join(ids, "_key").groupBy("component_id").agg(least.alias("least")).select("least._key"))
    rows = found.groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row")).join(kept, "_key", "left_semi")
    return rows.select("row.*").union(docs.filter(stay))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold no passage and stay; repeated rows stay or go together. An empty table or benchmark removes nothing.
    """
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    return found.filter("not contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own, the last one. Documents without words are sampled like others. Equal rows are separate
    documents, which of them is taken does not show. An empty table gives no rows.
    """
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot.

    Null ids and texts are dealt like others; equal rows are separate rows. An empty table gives no rows.
    """
    return sharding.shuffled_into_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic), ("near_duplicates", one_of_each), ("decontamination", not_in_benchmark), ("mixing", mixed), ("sharding", sharded)]

# A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = shared_table(docs)
    return docs
