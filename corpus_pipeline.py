"""From raw documents to sharded training text: stages over the operators of ``newsflow.llm``.

Every stage takes all documents that the one before it kept and returns the columns of ``documents``;
the last adds ``size``, ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm import decontaminate, langid, mixing, sharding, simhash
from newsflow.llm.common import DOCUMENT, table
from newsflow.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null texts, texts without a letter, and texts that share no n-gram with
    any language learned from the labelled documents go."""
    return langid.keep_known(docs).select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id."""
    return simhash.drop_near_duplicates(docs).select(*DOCUMENT)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes: a row per document and pass, shortened to the words taken."""
    return mixing.mixed_documents(docs).select(*DOCUMENT)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return sharding.shard(docs.select(*DOCUMENT))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

#: Language profiles, 64-bit text hashes and sampled splitters have no counterpart in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
