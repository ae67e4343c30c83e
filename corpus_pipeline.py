"""The corpus pipeline: documents in, token ids out, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import common, decontaminate, jaccard_join, langid, mixing, token_store


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go."""
    return langid.recognised_documents(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by the n-gram Jaccard join, one stays."""
    return jaccard_join.one_of_each(spark, docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean_documents(spark, docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed_documents(spark, docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store; a row for each document it holds."""
    return token_store.tokens_of(spark, docs)


STAGES = [("identify_languages", identify_languages), ("drop_near_copies", drop_near_copies), ("decontaminate", decontaminate_benchmark), ("mix_sources", mix_sources), ("store_tokens", store_tokens)]

#: Language models, random joins and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = common.staged()
        after = common.stage(spark, stage(spark, docs, sf_dir), name)
        if name != STAGES[-1][0]:  # what the stage itself has set down; the token store stays
            common.remove_staged(spark, before, after)
        if name != STAGES[0][0]:
            common.remove(spark, docs)
        docs = after
    return docs
