"""The corpus pipeline: five stages, each over all that the one before kept.

Language ID, toxicity, SimHash near-dedup and substring dedup return the columns of
``documents``; packing returns where each piece of a document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import language_id, packing, simhash, substring, toxicity
from lectern.llm.common import shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops blank documents and those whose text contradicts their language."""
    return language_id.accepted_only(docs, language_id.fit(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxic passage; the model learns from ``labels``."""
    return toxicity.clean_only(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near duplicates."""
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that occurred before."""
    return substring.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2,048 words."""
    return packing.packed(docs)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

#: Stages are classifiers and approximate search, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
