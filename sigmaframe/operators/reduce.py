"""Reductions, scans and normalisation over the positions of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PIECE


def total(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"))


def extremes(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """max and min; 0 without values."""
    return df.groupBy(*keys).agg(F.coalesce(F.max(value), F.lit(0.0)).alias("max"), F.coalesce(F.min(value), F.lit(0.0)).alias("min"))


def dot(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias("dot"))


#: Magnitudes whose squares neither overflow nor underflow, and the power of two that brings others there.
SAFE_LOW, SAFE_HIGH, SHIFT = 1e-140, 1e140, 2.0**500


def norm(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Euclidean norm that neither overflows nor underflows, in one aggregation.

    Small, middle and large magnitudes have a sum each, the outer two scaled by a power of two.
    """
    x = F.col(value)
    small, large = F.abs(x) < SAFE_LOW, (F.abs(x) > SAFE_HIGH) & ~F.isnan(x)
    sums = df.groupBy(*keys).agg(
        F.sum(F.when(small, (x * SHIFT) * (x * SHIFT)).otherwise(0.0)).alias("_s"),
        F.sum(F.when(small | large, 0.0).otherwise(x * x)).alias("_m"),
        F.sum(F.when(large, (x / SHIFT) * (x / SHIFT)).otherwise(0.0)).alias("_l"),
    )
    middle = F.sqrt(F.col("_m") + F.col("_s") / SHIFT / SHIFT)
    value = F.when(F.col("_l") > 0, SHIFT * F.sqrt(F.col("_l") + F.col("_m") / SHIFT / SHIFT)).when(F.col("_m") > 0, middle).otherwise(F.sqrt("_s") / SHIFT)
    return sums.select(*keys, F.coalesce(F.when(F.isnan("_m"), F.col("_m")).otherwise(value), F.lit(0.0)).alias("norm"))


def prefix_sum(df: DataFrame, keys: Sequence[str], position: str = "i", value: str = "v", length: int = PIECE) -> DataFrame:
    """Exclusive running sum, 0 at the first position.

    In two levels: within pieces of `length` positions, and over the sums of the pieces before.
    """
    cut = df.select(*keys, position, value, F.floor(F.col(position) / length).alias("_piece"))
    sums = cut.groupBy(*keys, "_piece").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("_ahead", F.sum("_sum").over(earlier)).select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_piece").alias("_of"), "_ahead")
    before = Window.partitionBy(*keys, "_piece").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    within = cut.select(*keys, position, "_piece", F.sum(value).over(before).alias("_within"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_piece") == F.col("_of")]
    scan = F.coalesce("_ahead", F.lit(0.0)) + F.coalesce("_within", F.lit(0.0))
    return within.join(ahead, same).select(*keys, position, scan.alias("scan"))


def softmax(df: DataFrame, keys: Sequence[str], position: str = "i", value: str = "v") -> DataFrame:
    """Over all positions of a series, the largest value subtracted first; 0 where the sum is 0."""
    group = Window.partitionBy(*keys)
    e = df.select(*keys, position, F.exp(F.col(value) - F.max(value).over(group)).alias("_e"))
    return e.select(*keys, position, F.coalesce(F.try_divide(F.col("_e"), F.sum("_e").over(group)), F.lit(0.0)).alias("softmax"))


def complex_dot(df: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """The sum of conj(a) times b."""
    ar, ai, br, bi = (F.col(c) for c in (*a, *b))
    return df.groupBy(*keys).agg(F.sum(ar * br + ai * bi).alias("re"), F.sum(ar * bi - ai * br).alias("im"))
