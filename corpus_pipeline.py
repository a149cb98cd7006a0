"""From documents to packed training pieces: five stages, each a table that the next one reads.

Language identification, toxicity, exact deduplication, near-duplicates and packing, in this order.
Every stage works on all rows that its predecessor kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import language, packing, toxicity
from attesta.llm.common import keep_rows
from attesta.llm.exact_dedup import exact_groups
from attesta.llm.near_copies import similar_groups
from attesta.session import new_folder, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts, texts without a letter and texts unlike all go."""
    return language.keep_known(docs, language.learn(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest id."""
    return keep_rows(docs, exact_groups(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles (similarity 0.8 or more) the row with the smallest id.

    Candidates are SimHash links (BK-trees) and min-hash buckets; each link is confirmed on whole texts.
    """
    return keep_rows(docs, similar_groups(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of what is left: its text, bucket, batch and place."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Hyperdimensional profiles, learned weights and min-hashes are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"{folder}/{name}")
    name, step = STAGES[-1]
    return stage(step(spark, docs, sf_dir), f"{folder}/{name}")
