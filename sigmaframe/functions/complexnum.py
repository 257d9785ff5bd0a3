"""Complex arithmetic on pairs of columns (re, im)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj_mul(a: Pair, b: Pair) -> Pair:
    """a times the conjugate of b."""
    return a[0] * b[0] + a[1] * b[1], a[1] * b[0] - a[0] * b[1]


def add(a: Pair, b: Pair) -> Pair:
    return a[0] + b[0], a[1] + b[1]


def scale(a: Pair, s: complex) -> Pair:
    return mul(a, (F.lit(float(s.real)), F.lit(float(s.imag))))


def magnitude(a: Pair) -> Column:
    return F.hypot(a[0], a[1])


def magnitude_squared(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def phase(a: Pair) -> Column:
    return F.atan2(a[1], a[0])


def unit(angle: Column) -> Pair:
    """e to the power of i times angle."""
    return F.cos(angle), F.sin(angle)


def dot(a: Pair, b: Pair) -> Pair:
    """Aggregates: the sum of conj(a) times b."""
    return F.sum(a[0] * b[0] + a[1] * b[1]), F.sum(a[0] * b[1] - a[1] * b[0])


def from_interleaved(samples: Column) -> Column:
    """array<struct<re,im>> of an array [re, im, re, im, ...]."""
    return F.transform(F.sequence(F.lit(0), (F.size(samples) / 2).cast("int") - 1), lambda k: F.struct(samples[2 * k].alias("re"), samples[2 * k + 1].alias("im")))
