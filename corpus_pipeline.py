"""A pipeline over documents: language, toxicity, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyspark.llm import langid, ngram_join, packing, pii, toxicity
from glyspark.llm._io import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no text, no letter, or a score below the rejection level."""
    return langid.keep_known(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from the labels of this stage's documents."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets."""
    return pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language_id), ("toxicity", toxicity_filter), ("n-gram Jaccard join", ngram_jaccard_join), ("PII", personal_data), ("best-fit packing", best_fit_packing)]

#: Learned models and tokenisers are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            work.drop(f"stage{k - 1}")
        work.free()
    return docs
