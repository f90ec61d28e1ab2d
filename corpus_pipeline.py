"""Builds a training corpus from documents, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import bpe, language_id, mixing, simhash, toxicity
from vecloom.llm.common import shared_dir, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that language ID rejects, each judged by its own text.

    Null, empty and blank texts are rejected; null ids, repeated rows and very long texts are judged like others. An empty
    table, or one without any labelled row, gives an empty result.
    """
    return language_id.accepted(docs, language_id.fit(docs))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without toxic rows, each judged by its own text.

    Null and empty texts are not toxic. Without labels of both kinds nothing is toxic. Null ids, repeated rows and very
    long texts are judged like others. An empty table gives an empty result.
    """
    return toxicity.civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the least id, null ids last.

    Of rows that are equal in id and text one stays, any of them; rows of one id with other texts are documents of their
    own. Empty and blank texts are copies of each other. Null texts are never copies, and stay. An empty table gives an
    empty result.
    """
    return simhash.unique(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that mixing chooses, each for itself: null ids take part, and a row doesn't come in by another's id.

    Null and empty texts have no tokens and go with their block; null sources are one source. An empty table gives an empty
    result.
    """
    return mixing.chosen(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens) of each row, of the whole text; null for a null text, no tokens for an empty one."""
    return bpe.encode(docs)


STAGES = [("language ID", languages), ("toxicity", civil), ("SimHash near-dedup", unique), ("mixing", mixed), ("BPE", tokens)]

#: Language ID, toxicity, SimHash and BPE can't be expressed in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens) of the rows of documents that all stages keep.

    Each stage's result is written to the shared folder, and deleted when the next but one is written. What stages do with
    nulls, empty and long texts, ties, repeated rows and an empty table is said at each; columns beyond those of documents
    are carried as they are. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
