"""Corpus pipeline: five stages over the documents table, each one of the numbered operators at work.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which writes the token
shards and returns their index. run() writes each stage's rows as Parquet in the shared folder and reads them again.
The mix is written in order of its training positions, and the shards hold the documents in the order written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrace.llm.common import shared_folder
from terrace.llm.decontamination import decontaminated
from terrace.llm.jaccard_join import one_of_each
from terrace.llm.mixing import mixed_documents
from terrace.llm.quality import good_documents
from terrace.llm.token_binary import stored_order, token_binary

#: Ends each document in the token shards.
END_ID = 2
#: Parts of words that a worker keeps; the stages before have their part of its memory too.
WORDS = 50_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, doesn't reject."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, in order of their training positions."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token shards, read back. docs are read from Parquet; their order there is the shards' order."""
    return token_binary(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, order=stored_order(docs), words=WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mixing),
    ("token ids", token_ids),
]
#: Trained models, components and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        folder = shared_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
