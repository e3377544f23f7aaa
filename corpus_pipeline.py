"""The document pipeline: each stage takes the rows that the one before kept.

A document that the quality classifier rejects goes; one document of each class of
near-duplicates stays; personal data is replaced in the texts; documents are taken as often as
their source's target asks for; the last stage returns the pieces of the
packed sequences.  A stage's result is written as Parquet and read again.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import job_conf, read
from tidelog.llm.mixing import mixed
from tidelog.llm.ngram_join import one_of_each_class
from tidelog.llm.pii import redacted
from tidelog.llm.quality_knn import of_quality
from tidelog.llm.vector_packing import pack
from tidelog.session import ensure_checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    job_conf(spark)
    return of_quality(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    job_conf(spark)
    return one_of_each_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    job_conf(spark)
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    job_conf(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    job_conf(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mixing),
    ("packing", packing),
]

#: Trained models and the tokenizer are beyond SQL; tests hold run() against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results go between stages as Parquet in the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    folder = os.path.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
