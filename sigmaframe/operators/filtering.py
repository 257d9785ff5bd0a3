"""FIR and IIR filters, convolutions and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import in_pieces
from .batches import padded, per_series, unpadded


def _slid(value: str, window: Window, taps: Sequence[float]) -> Column:
    terms = [F.lead(value, k).over(window) * F.lit(float(h)) for k, h in enumerate(taps)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def fir(df: DataFrame, keys: Sequence[str], taps: Sequence[float], position: str = "i", value: str = "v", out: str = "v") -> DataFrame:
    """Sliding dot product with the taps, valid part, no flip; a series shorter than the taps has no rows."""
    if not taps:
        return df.select(*keys, position, F.col(value).alias(out)).limit(0)
    window = Window.partitionBy(*keys, "_piece").orderBy(position)
    cut = in_pieces(df.select(*keys, position, value), position, 0, len(taps) - 1)
    done = cut.select(*keys, position, "_own", _slid(value, window, taps).alias("_y"), F.lead(F.lit(1), len(taps) - 1).over(window).alias("_whole"))
    return done.where("_own and _whole is not null").select(*keys, position, F.col("_y").alias(out))


def convolve_valid(df: DataFrame, keys: Sequence[str], taps: Sequence[float], **names) -> DataFrame:
    """FIR with the taps reversed."""
    return fir(df, keys, list(reversed(taps)), **names)


def convolve_full(df: DataFrame, keys: Sequence[str], taps: Sequence[float], position: str = "i", value: str = "v", out: str = "v") -> DataFrame:
    """Zero-padded convolution, length n + taps - 1: each sample is spread over the taps and summed by position."""
    spread = F.posexplode(F.array(*(F.lit(float(h)) for h in taps))).alias("_k", "_h")
    rows = df.select(*keys, position, F.col(value).alias("_v"), spread)
    return rows.groupBy(*keys, (F.col(position) + F.col("_k")).alias(position)).agg(F.sum(F.col("_v") * F.col("_h")).alias(out))


def correlate2d(grid: DataFrame, kernel: Sequence[Sequence[float]], flip: bool = False, value: str = "v", kind: str = "double") -> DataFrame:
    """Valid 2-D correlation of grids (g, d, r, v); flip makes it a convolution.

    Sums along r are windows over a grid row; sums along d add the kernel rows of neighbouring rows.
    """
    rows = [list(reversed(k)) for k in reversed(kernel)] if flip else [list(k) for k in kernel]
    tall, wide = len(rows), len(rows[0])
    along = Window.partitionBy("g", "d").orderBy("r")
    down = Window.partitionBy("g", "r").orderBy("d")
    x = grid.select("g", "d", "r", F.col(value).cast(kind).alias("_v"))
    for k, taps in enumerate(rows):
        total = None
        for c, h in enumerate(taps):
            term = F.lead("_v", c).over(along) * F.lit(h).cast(kind)
            total = term if total is None else total + term
        x = x.withColumn(f"_k{k}", total)
    x = x.where(F.col("_k0").isNotNull())
    total = None
    for k in range(tall):
        term = F.lead(f"_k{k}", k).over(down)
        total = term if total is None else total + term
    return x.select("g", "d", "r", total.alias("v")).where("v is not null")


def convolve2d(grid: DataFrame, kernel: Sequence[Sequence[float]], **names) -> DataFrame:
    return correlate2d(grid, kernel, flip=True, **names)


def correlate2d_int8(grid: DataFrame, kernel: Sequence[Sequence[int]], value: str = "v") -> DataFrame:
    """Exact on 8-bit integers: summed in 64 bits, returned as 32-bit integers."""
    return correlate2d(grid, kernel, value=value, kind="bigint").withColumn("v", F.col("v").cast("int"))


def separable2d(grid: DataFrame, column: Sequence[float], row: Sequence[float]) -> DataFrame:
    """Rows, then columns; equal to correlate2d with the outer product of column and row."""
    return fir(fir(grid, ["g", "d"], row, "r"), ["g", "r"], column, "d").select("g", "d", "r", "v")


def resample(df: DataFrame, keys: Sequence[str], taps: Sequence[float], up: int, down: int, position: str = "i", value: str = "v") -> DataFrame:
    """Polyphase resampling by up/down with zero history; invalid rates or no taps give no rows.

    Output m has phase (m * down) mod up and newest input (m * down) div up, so every input is spread
    over the outputs that it reaches and outputs are sums: no state is needed.
    """
    if up < 1 or down < 1 or not taps:
        return df.select(*keys, F.col(position), F.col(value).alias("v")).limit(0)
    reach = math.ceil(len(taps) / up)
    coefficients = F.array(*(F.lit(float(h)) for h in taps))
    sizes = df.groupBy(*keys).agg(F.max(position).alias("_last"))
    x = df.select(*keys, F.col(position).cast("long").alias("_i"), F.col(value).alias("_v"))
    low = F.ceil(F.col("_i") * up / down).cast("long")
    high = F.floor(((F.col("_i") + reach) * up - 1) / down).cast("long")
    spread = x.select(*keys, "_i", "_v", F.explode(F.sequence(low, F.greatest(high, low))).alias("_m"))
    k = F.floor(F.col("_m") * down / up).cast("long") - F.col("_i")
    tap = (F.col("_m") * down) % up + k * up
    used = spread.withColumn("_tap", tap.cast("int")).where((k >= 0) & (F.col("_tap") < len(taps)))
    used = used.select(*keys, "_m", (F.col("_v") * F.get(coefficients, F.col("_tap"))).alias("_y"))
    grid = sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.floor(((F.col("_last") + 1) * up - 1) / down).cast("int"))).alias("_m"))
    both = used.unionByName(grid.select(*keys, F.col("_m").cast("long").alias("_m"), F.lit(0.0).alias("_y")))
    last = sizes.select(*(F.col(c).alias(f"_{c}") for c in keys), "_last")
    summed = both.groupBy(*keys, "_m").agg(F.sum("_y").alias("v"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return summed.join(last, same).where(F.col("_m") * down < (F.col("_last") + 1) * up).select(*keys, F.col("_m").cast("int").alias(position), "v")


@dataclass(frozen=True)
class Biquad:
    b0: float = 1.0
    b1: float = 0.0
    b2: float = 0.0
    a1: float = 0.0
    a2: float = 0.0
    ok: bool = True


def design(kind: str, cutoff: float, rate: float, q: float = math.sqrt(0.5)) -> Biquad:
    """Second-order section by the audio-cookbook formulas; invalid parameters give a pass-through with ok false."""
    if not (rate > 0 and q > 0 and 0 < cutoff < rate / 2):
        return Biquad(ok=False)
    w = 2 * math.pi * cutoff / rate
    cos, alpha = math.cos(w), math.sin(w) / (2 * q)
    forms = {
        "lowpass": ((1 - cos) / 2, 1 - cos, (1 - cos) / 2),
        "highpass": ((1 + cos) / 2, -(1 + cos), (1 + cos) / 2),
        "bandpass": (alpha, 0.0, -alpha),
        "notch": (1.0, -2 * cos, 1.0),
    }
    b = [x / (1 + alpha) for x in forms[kind]]
    return Biquad(*b, -2 * cos / (1 + alpha), (1 - alpha) / (1 + alpha))


def run_sections(x: np.ndarray, sections: Sequence[Biquad], state: np.ndarray) -> np.ndarray:
    """Filters rows of x side by side through sections in series; state (section, 2, row) is updated."""
    y = x.copy()
    for s, c in enumerate(sections):
        s1, s2 = state[s]
        for t in range(y.shape[1]):
            v = y[:, t]
            o = c.b0 * v + s1
            s1, s2 = c.b1 * v - c.a1 * o + s2, c.b2 * v - c.a2 * o
            y[:, t] = o
        state[s] = s1, s2
    return y


def biquad(df: DataFrame, keys: Sequence[str], sections: Biquad | Sequence[Biquad], position: str = "i", value: str = "v") -> DataFrame:
    """Transposed direct form II from rest, sections in series; the series of a batch run side by side."""
    chain = [sections] if isinstance(sections, Biquad) else list(sections)

    def run(series):
        x, sizes = padded(series)
        return [unpadded(run_sections(x, chain, np.zeros((len(chain), 2, len(x)))), sizes)]

    return per_series(df, keys, position, [value], run, ["v"])


def biquad_fold(values: Column, c: Biquad) -> Column:
    """One section over an array column without leaving the JVM; for short arrays."""
    state = "struct<s1:double,s2:double,y:array<double>>"
    start = F.struct(F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"), F.array().cast("array<double>").alias("y")).cast(state)

    def step(s: Column, v: Column) -> Column:
        o = v * F.lit(c.b0) + s["s1"]
        return F.struct((v * F.lit(c.b1) - o * F.lit(c.a1) + s["s2"]).alias("s1"), (v * F.lit(c.b2) - o * F.lit(c.a2)).alias("s2"), F.concat(s["y"], F.array(o)).alias("y")).cast(state)

    return F.aggregate(values, start, step)["y"]
