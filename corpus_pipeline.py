"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from sigmaframe.llm.minhash import drop_near_duplicates
from sigmaframe.llm.packing import pieces
from sigmaframe.llm.queries import END_ID, VOCABULARY
from sigmaframe.llm.secrets import redact
from sigmaframe.llm.suffixes import remove_repeats
from sigmaframe.llm.textkit import shared_folder, stored
from sigmaframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; n_chars follows the text."""
    columns = docs.columns
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live secrets replaced by a mark; n_chars follows the text."""
    columns = docs.columns
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length with their token ids."""
    return pieces(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secret_scan", secret_scan), ("packing", packing)]

#: SQL can't express learnt scores, sampling or byte-pair encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
