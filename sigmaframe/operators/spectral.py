"""Windows, Fourier transforms and Doppler processing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import per_series

WINDOWS = ("rectangular", "hamming", "hann", "blackman", "blackman_harris", "kaiser", "gaussian", "tukey")
#: Fixed coefficients of the cosine-sum windows.
COSINE_SUMS = {"hamming": (0.54, 0.46), "hann": (0.5, 0.5), "blackman": (0.42, 0.5, 0.08), "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168)}


def window_value(i: Column, n: int, kind: str, parameter: float | None = None) -> Column:
    """Symmetric window at position i of n; parameter is beta (kaiser, 5), sigma (gaussian, 0.4) or the taper (tukey, 0.5)."""
    if kind not in WINDOWS:
        raise ValueError(f"window must be one of {WINDOWS}")
    if n == 1 or kind == "rectangular":
        return F.lit(1.0)
    if kind in COSINE_SUMS:
        total = F.lit(0.0)
        for k, c in enumerate(COSINE_SUMS[kind]):
            total = total + F.lit((-1) ** k * c) * F.cos(2 * math.pi * k * i / (n - 1))
        return total
    if kind == "kaiser":
        beta = 5.0 if parameter is None else parameter
        x = 2 * np.arange(n) / (n - 1) - 1
        values = np.i0(beta * np.sqrt(np.clip(1 - x * x, 0, None))) / np.i0(beta)
        return F.get(F.array(*(F.lit(float(v)) for v in values)), i.cast("int"))
    half = (n - 1) / 2
    if kind == "gaussian":
        sigma = 0.4 if parameter is None else parameter
        x = (i - half) / (sigma * half)
        return F.exp(-0.5 * x * x)
    taper = 0.5 if parameter is None else parameter
    edge = taper * half
    rise = lambda x: 0.5 * (1 + F.cos(math.pi * (x / edge - 1))) if edge > 0 else F.lit(1.0)
    return F.when(i < edge, rise(i)).when(i > n - 1 - edge, rise(F.lit(n - 1) - i)).otherwise(1.0)


def window(spark: SparkSession, n: int, kind: str, parameter: float | None = None) -> DataFrame:
    """(i, w) of a window of n points."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"), window_value(F.col("id"), max(n, 1), kind, parameter).alias("w"))


def apply_window(df: DataFrame, n: int, kind: str, values: Sequence[str], position: str = "i", parameter: float | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Multiplies values at each position by an n-point window, as an expression of the position.

    With keys, a series whose length is not n stays as it is; without, every series is taken to have n
    points, and positions beyond stay as they are.
    """
    fits = F.col(position) < n
    if keys is not None:
        sizes = df.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg((F.max(position) + 1).alias("_points"))
        df = df.join(sizes, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] or F.lit(True)).drop(*(f"_of_{k}" for k in keys))
        fits = F.col("_points") == n
    w = F.when(fits, window_value(F.col(position), n, kind, parameter)).otherwise(1.0)
    return df.withColumns({v: F.col(v) * w for v in values}).drop("_points")


def _transformed(one, norm: str | None = None):
    def run(re, im):
        out = [one(a + 1j * b) for a, b in zip(re, im)]
        return [[x.real for x in out], [x.imag for x in out]]

    return run


def fft(df: DataFrame, keys: Sequence[str], position: str = "i", inverse: bool = False, norm: str = "backward", size: int | None = None) -> DataFrame:
    """Transform of (re, im) along position; the inverse divides by n, unless norm is "none".

    With size, every series has that many points: absent positions are zeros, and positions beyond fold
    onto position mod size. Without, its rows are its points, in order of position.
    """
    one = (lambda x: np.fft.ifft(x) * (len(x) if norm == "none" else 1)) if inverse else np.fft.fft
    if size is None:
        return per_series(df, keys, position, ["re", "im"], _transformed(one), ["re", "im"])

    def placed(at, re, im):
        out = []
        for k, a, b in zip(at, re, im):
            full = np.zeros(size, complex)
            np.add.at(full, k.astype(np.int64) % size, a + 1j * b)
            out.append(one(full))
        return [[x.real for x in out], [x.imag for x in out]]

    return per_series(df.withColumn("_at", F.col(position).cast("double")), keys, position, ["_at", "re", "im"], placed, ["re", "im"])


def rfft(df: DataFrame, keys: Sequence[str], position: str = "i", value: str = "v") -> DataFrame:
    """The non-redundant half of the transform of a real series."""

    def run(v):
        out = [np.fft.rfft(x) for x in v]
        return [[x.real for x in out], [x.imag for x in out]]

    return per_series(df, keys, position, [value], run, ["re", "im"])


def irfft(df: DataFrame, keys: Sequence[str], n: int, position: str = "i") -> DataFrame:
    """The real series of length n of a half transform."""

    def run(re, im):
        return [[np.fft.irfft(a + 1j * b, n) for a, b in zip(re, im)]]

    return per_series(df, keys, position, ["re", "im"], run, ["v"])


def fft2(grid: DataFrame, inverse: bool = False, norm: str = "none", shape: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """2-D transform of grids (g, d, r, re, im): along r, then along d.

    shape is the points along d and along r, as size of fft(); without it, a grid has the points of its rows.
    """
    along = fft(grid, ["g", "d"], "r", inverse, norm, shape[1])
    return fft(along, ["g", "r"], "d", inverse, norm, shape[0]).select("g", "d", "r", "re", "im")


def dft_join(df: DataFrame, keys: Sequence[str], n: int, position: str = "i", inverse: bool = False) -> DataFrame:
    """The transform of n points as spread and sum, for positions below n; relational counterpart of fft."""
    sign = 1.0 if inverse else -1.0
    spread = df.select(*keys, position, "re", "im", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k"))
    angle = F.lit(sign * 2 * math.pi / n) * ((F.col("_k") * F.col(position)) % n)
    c, s = F.cos(angle), F.sin(angle)
    sums = spread.groupBy(*keys, F.col("_k").alias(position)).agg(F.sum(F.col("re") * c - F.col("im") * s).alias("re"), F.sum(F.col("re") * s + F.col("im") * c).alias("im"))
    return sums


def doppler(pulses: DataFrame, size: int, taper: str | None = None, count: int | None = None) -> DataFrame:
    """Transform over the pulses p of each range cell r of grids (g, p, r, re, im), size points.

    More pulses than points fold onto p mod size, fewer are padded with zeros; no normalisation. With
    taper, pulses are first weighted by a window of count points, also where a grid has fewer pulses;
    without count, by one over the pulses of their grid. Pulses beyond count keep their values.
    """
    x = pulses
    if taper is not None:
        if count is None:
            counts = pulses.groupBy(F.col("g").alias("_g")).agg((F.max("p") + 1).alias("_n"))
            x = x.join(counts, F.col("g").eqNullSafe(F.col("_g")))
        else:
            x = x.withColumn("_n", F.lit(count))
        total = F.lit(0.0)
        for k, c in enumerate(COSINE_SUMS[taper]):
            total = total + F.lit((-1) ** k * c) * F.cos(2 * math.pi * k * F.col("p") / F.greatest(F.col("_n") - 1, F.lit(1)))
        w = F.when((F.col("_n") == 1) | (F.col("p") >= F.col("_n")), 1.0).otherwise(total)
        x = x.select("g", "p", "r", (F.col("re") * w).alias("re"), (F.col("im") * w).alias("im"))
    folded = x.groupBy("g", "r", (F.col("p") % size).alias("d")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return fft(folded, ["g", "r"], "d", size=size).select("g", "d", "r", "re", "im")
