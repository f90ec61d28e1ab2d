"""The queries of this subpackage, each over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import ann, bpe, embedding_dedup, language_id, lm, mixing, simhash, token_counts, toxicity, warc
from vecloom.llm.common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(table(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.assemble(warc.parse(warc.records_of_pages(table(spark, sf_dir, "pages"))))


def warc_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.flat(op5_warc(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_simhash": op2_simhash,
    "op3_lm": op3_lm,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "warc_flat": warc_flat,
    "op6_language_id": op6_language_id,
    "op7_ann": op7_ann,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.SQL,
    "op3_lm": lm.SQL,
    "warc_flat": warc.FLAT_SQL,
    "op10_mixing": mixing.SQL,
}
