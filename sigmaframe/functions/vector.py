"""Element-wise column functions. All compute in double precision; nulls give nulls."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
NAN = float("nan")


def div(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity with the sign of both operands, 0/0 and NaN give NaN."""
    negative_zero = (b == 0) & (b.cast("string") == "-0.0")
    sign = F.when(negative_zero, -F.signum(a)).otherwise(F.signum(a))
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(sign * F.lit(INFINITY))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def safe_div(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """a / (b + eps), with eps taken with the sign of b (positive at 0)."""
    return F.try_divide(a, b + F.when(b >= 0, F.lit(eps)).otherwise(F.lit(-eps)))


def relu(x: Column) -> Column:
    """Negative values become 0; NaN stays."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * alpha)


def clamped(x: Column, bound: float | None) -> Column:
    return x if bound is None else F.least(F.greatest(x, F.lit(-float(bound))), F.lit(float(bound)))


def sigmoid(x: Column, clamp: float | None = None) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamped(x, clamp)))


def tanh(x: Column, clamp: float | None = None) -> Column:
    return F.tanh(clamped(x, clamp))


def gelu(x: Column) -> Column:
    """The tanh approximation."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def exp(x: Column, clamp: float | None = None) -> Column:
    return F.exp(clamped(x, clamp))


def dot_arrays(a: Column, b: Column) -> Column:
    """Dot product of two array columns; 0 if their lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def fir_array(x: Column, taps: Column) -> Column:
    """Sliding dot product of an array with taps, valid part, no flip; empty if the taps are longer."""
    n = F.size(x) - F.size(taps)
    one = lambda k: F.aggregate(F.zip_with(F.slice(x, k + 1, F.size(taps)), taps, lambda v, h: v * h), F.lit(0.0), lambda s, v: s + v)
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), one)).otherwise(F.array().cast("array<double>"))
