"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages rows are
written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm.common import drop_table, materialize
from strandmill.llm.mixing import mixed_documents
from strandmill.llm.packing import numbered, pack
from strandmill.llm.quality import keep_good
from strandmill.llm.simhash import keep_one
from strandmill.llm.substring import clean_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the stored labels, scores at least 0.3."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of sentences that an earlier document has."""
    return clean_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each copy of each document lies in sequences of 2048 tokens."""
    return numbered(*pack(docs))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: A learned classifier, fixed points and tokenization can't be said in SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            found = materialize(found, f"stage{number}")
            if number:
                drop_table(docs)
        docs = found
    return docs
