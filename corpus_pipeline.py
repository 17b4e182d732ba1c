"""A corpus pipeline of five of the training-data operators.

Each stage reads what the one before it kept and returns rows with the columns of documents;
the last returns a row for every time the mix takes a document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from abspark.llm import decontaminate, mixing, setsketch, suffix_dedup, toxicity
from abspark.llm.common import shared_folder, table
from abspark.session import prepare

NEAR_SHINGLE = 5  # words in a shingle of the stage near_copies; op10 has its own


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles), the one with the
    smallest doc_id."""
    return setsketch.deduplicate(docs, NEAR_SHINGLE)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller doc_id has."""
    return suffix_dedup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark", drop_benchmark),
    ("mix", mix),
]
ORACLE_SQL = None  # the toxicity model has no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
