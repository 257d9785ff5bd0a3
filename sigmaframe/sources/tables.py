"""Signals, complex signals, matrices and grids from the star-schema tables, and their storage.

Readers are plain Parquet scans with the columns they need, so pruning and filters reach the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, i, v): every user's event values in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return e.select(F.col("user_id").alias("series"), (F.row_number().over(order) - 1).alias("i"), F.col("value").alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, i, v): every embedding's components."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))


def complex_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, i, re, im): neighbouring embeddings as real and imaginary parts."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("series"), (F.col("vec_id") % 2).alias("part"), F.col("embedding").cast("array<double>").alias("x"))
    both = e.groupBy("series").agg(F.max(F.when(F.col("part") == 0, F.col("x"))).alias("re"), F.max(F.when(F.col("part") == 1, F.col("x"))).alias("im"))
    return both.select("series", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z")).select("series", "i", F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def matrices(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    """(m, i, j, v): every `rows` embeddings in a row as a matrix."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr(f"vec_id div {rows}").alias("m"), (F.col("vec_id") % rows).alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))


def grids(spark: SparkSession, sf_dir: str, rows: int = 20) -> DataFrame:
    """(g, d, r, v): the squares of matrices, as power maps."""
    return matrices(spark, sf_dir, rows).select(F.col("m").alias("g"), F.col("i").alias("d"), F.col("j").alias("r"), (F.col("v") * F.col("v")).alias("v"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, i, v): quantity shipped a day and return flag, days numbered in order."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("v"))
    return x.select("series", (F.row_number().over(Window.partitionBy("series").orderBy("day")) - 1).alias("i"), "v")


def save(df: DataFrame, path: str, keys: Sequence[str] = (), partitions: int | None = None) -> None:
    """Writes a long form dealt and sorted by its keys, so that later grouping reads close rows together."""
    if keys:
        df = (df.repartition(partitions, *keys) if partitions else df.repartition(*keys)).sortWithinPartitions(*keys)
    df.write.mode("overwrite").parquet(path)
