"""A corpus from raw documents to packed sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet
and reads it again for the next. All but the last return the columns of `documents`, and
further columns of any name with their values. Texts are used whole, however long; an empty
table stays an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import mixture, oddsketch, packing, secret_scan, toxicity
from cellweave.llm.shared import pin


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    Null and empty texts hold no terms: they stay where the labels make clean texts likelier.
    Null ids are judged like others; repeated rows have one score and stay or go together. Without
    toxic labels every document stays.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id.

    Null, empty and blank texts and rows of a null id link with nothing and stay. Repeated
    rows of the document that stays all stay; of one id with several texts each is judged by
    its own text.
    """
    return oddsketch.deduplicate(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the texts; all documents stay.

    Null texts stay null, empty ones empty. Rows of null or repeated ids are replaced each by
    its own text; a null source or lang is an owner or repository of its own.
    """
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them.

    Documents without words (null, empty or blank texts) have nothing to take and stand
    once. A null source is a source of its own. Repeated rows of one id, source and text share
    what the mix takes of them. Ties of the order are broken by id and size.
    """
    return mixture.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences.

    Null and empty texts are one piece, the end token. Null and repeated ids have pieces of
    their own for each row.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("packing", packed),
]

#: SQL can express neither the learned scores nor the sketches; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs
