"""The corpus pipeline: quality rules, near-duplicates, private values, mixing, packing, each on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame, written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellsense.llm import jaccard_join, mixing, packing, pii, quality_rules
from cellsense.llm.common import written
from cellsense.llm.queries import PII_KEY, vocabulary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    return jaccard_join.distinct(docs, percent=80, width=5)


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private numbers, dates, addresses and credentials get pseudonyms."""
    return pii.pseudonymise(docs, PII_KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their source's weight asks."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all that is left, packed into sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("PII", private_values), ("mixing", mixture), ("packing", sequences)]

#: Tokenising and the Feistel permutations aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
