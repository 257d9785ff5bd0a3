"""Canonical long forms and their checks.

signal: series, i, v      csignal: series, i, re, im      matrix: m, i, j, v
grid: g, d, r, v          mchan: ch, t, v                 cgrid: g, p, r, re, im
Positions start at 0 without gaps. Values are doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Casts positions to int and values to double; a null value fails the query."""
    checked = [F.coalesce(F.col(v).cast("double"), F.raise_error(F.lit(f"null in column {v}")).cast("double")).alias(v) for v in values]
    return df.select(*keys, *checked)


def gaps(df: DataFrame, keys: Sequence[str], position: str = "i") -> DataFrame:
    """The groups whose positions are not 0, 1, ..., n - 1, each once."""
    seen = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(position).alias("distinct"), F.min(position).alias("first"), F.max(position).alias("last"))
    return seen.where((F.col("first") != 0) | (F.col("last") != F.col("n") - 1) | (F.col("distinct") != F.col("n"))).select(*keys)


def to_arrays(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """One row a series, with its values as arrays in order of position."""
    ordered = F.array_sort(F.collect_list(F.struct(position, *values)))
    return df.groupBy(*keys).agg(ordered.alias("_rows")).select(*keys, *(F.col(f"_rows.{v}").alias(v) for v in values))


def to_rows(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """The inverse of to_arrays."""
    zipped = F.posexplode(F.arrays_zip(*values)).alias(position, "_row")
    return df.select(*keys, zipped).select(*keys, position, *(F.col(f"_row.{v}").alias(v) for v in values))


#: Positions of a series that one task works on in windowed operators; longer series are cut by position.
PIECE = 65_536


def in_pieces(df: DataFrame, position: str, before: int, after: int, length: int | None = None) -> DataFrame:
    """df with `_piece`, the part of a series that a row belongs to, and `_own`.

    The `before` rows that precede a piece and the `after` rows that follow it are in it too, with
    `_own` false, so that frames of that reach see the same rows as in the whole series.
    """
    length = max(length or PIECE, before + after + 1)
    piece, within = F.floor(F.col(position) / length), F.col(position) % length
    copies = F.array(piece, F.when((within < after) & (piece > 0), piece - 1), F.when(within >= length - before, piece + 1))
    return df.withColumn("_home", piece).withColumn("_piece", F.explode(F.array_compact(copies))).withColumn("_own", F.col("_piece") == F.col("_home")).drop("_home")
