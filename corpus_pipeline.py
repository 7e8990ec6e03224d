"""A training-data pipeline over ``documents``: language, quality, exact and near duplicates, packing.

Each stage is one operator of ``plumbline.llm``, takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, language_id, ngram_join, packing, quality
from plumbline.llm.common import shared_folder, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; text without letters or of no known language goes."""
    return language_id.accepted_documents(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold of the line model, which is fitted on those left of the labelled ones."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, up to the case of A-Z: the one of the largest id."""
    return exact_dedup.exact_duplicates_dropped(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates: five-word shingles, similarity of 0.8 or more, linked directly or over others."""
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each remaining document: bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [("language ID", known_language), ("quality classifier", good_quality), ("exact dedup", distinct), ("n-gram Jaccard join", no_near_copies), ("packing", packed)]
#: the language and quality models have no SQL form; the tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read back, so a lost executor costs one stage."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
