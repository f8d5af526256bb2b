"""The corpus pipeline over `documents`: quality, toxicity, near duplicates, packing.

Each stage calls one operator of tiersum.llm on all that its predecessor kept; its result is written as Parquet and
read again. The first three return documents with all their columns, the last one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiersum.llm import packing, quality, shingles, toxicity
from tiersum.llm.common import materialize, table


#: Runs that a worker keeps while it packs: fewer than by default, since its executor has run three stages before.
PACKING_CACHE = 200_000


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labelled ones among docs, doesn't take for junk."""
    return quality.select_documents(docs, quality.fit(docs, quality.usability(table(spark, sf_dir, "labels"))))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.select_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: five-word shingles at a similarity of 0.8 or more.

    SimHash fingerprints and their Golay keys propose pairs first, minima those that Golay keys can't reach.
    """
    return shingles.select_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the windows of 4,096 tokens; null and empty texts are the end id alone."""
    return packing.pack_documents(docs, cache_size=PACKING_CACHE)


STAGES = [("quality", keep_sound), ("toxicity", keep_civil), ("near-duplicates", keep_one_of_each_group), ("packing", pack)]
#: Models, similarity of shingles and tokenization are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
