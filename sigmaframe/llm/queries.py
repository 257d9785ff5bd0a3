"""The queries that apply each operator of this subpackage to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

#: Vocabulary of the packing and encoding queries, and the id that closes a packed document.
VOCABULARY, END_ID = "word_bpe_49k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import report

    return report(_table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import report

    return report(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pieces

    return pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID, with_ids=False)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import filter_quality

    return filter_quality(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report

    return report(_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import report

    return report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_embeddings": op2_embeddings,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_secrets": op9_secrets,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL: dict[str, str] = {}
