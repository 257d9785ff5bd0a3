"""Correlation, ambiguity maps, detectors and adaptive filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import in_pieces, to_arrays, to_rows
from ..shipping import ship
from .batches import map_arrays, padded, per_series, unpadded


def _chosen(strategy: str) -> str:
    """What runs for a strategy; "auto" is whole series by transform, which does fewer products than the join for every size."""
    if strategy not in ("auto", "arrow", "relational"):
        raise ValueError("strategy must be auto, arrow or relational")
    return "arrow" if strategy == "auto" else strategy


def _beside(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The series that both have, as arrays x_* and y_*: one row a series."""
    x, y = (to_arrays(d, keys, "i", values) for d in (a, b))
    return x.select(*keys, *(F.col(v).alias(f"x_{v}") for v in values)).join(y.select(*keys, *(F.col(v).alias(f"y_{v}") for v in values)), list(keys))


def _transform_size(n: int) -> int:
    return 1 << int(np.ceil(np.log2(max(2, n))))


def xcorr(x: DataFrame, y: DataFrame, keys: Sequence[str], position: str = "i", strategy: str = "auto") -> DataFrame:
    """Full cross-correlation of (re, im) or (v): out[k] is the sum of x[n] times conj(y[n + k - (ny - 1)]).

    Lags 0 to nx + ny - 2; lags without overlap are 0. "arrow" (and "auto") multiplies the transforms of
    whole series; "relational" joins all pairs of a series, for series that no task holds.
    """
    real = "v" in x.columns
    cols = ["v"] if real else ["re", "im"]
    if _chosen(strategy) == "arrow":
        one = lambda parts: parts[0] if real else parts[0] + 1j * parts[1]

        def run(*columns):
            out = []
            for parts in zip(*columns):
                a, b = one(parts[: len(cols)]), one(parts[len(cols) :])
                size = _transform_size(2 * max(len(a), len(b)))  # no lag meets another one
                both = np.fft.ifft(np.conj(np.fft.fft(a, size)) * np.fft.fft(b, size)) if not real else np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)
                lags = np.arange(len(a) + len(b) - 1) - (len(b) - 1)
                out.append(np.conj(both[lags % size]))
            return [out] if real else [[z.real for z in out], [z.imag for z in out]]

        named = [d.select(*keys, F.col(position).alias("i"), *cols) for d in (x, y)]
        arrays = map_arrays(_beside(*named, keys, cols), keys, [f"{s}_{c}" for s in "xy" for c in cols], run, cols)
        return to_rows(arrays, keys, position, cols)
    a = x.select(*keys, F.col(position).cast("int").alias("_n"), *(F.col(c).alias(f"x_{c}") for c in cols))
    b = y.select(*(F.col(k).alias(f"y_{k}") for k in keys), F.col(position).cast("int").alias("_j"), *(F.col(c).alias(f"y_{c}") for c in cols))
    same = [F.col(k) == F.col(f"y_{k}") for k in keys]
    nx = x.groupBy(*keys).agg((F.max(position) + 1).cast("int").alias("_nx"))
    ny = y.groupBy(*(F.col(k).alias(f"y_{k}") for k in keys)).agg((F.max(position) + 1).cast("int").alias("_ny"))
    sizes = nx.join(ny, same).select(*keys, "_nx", "_ny")
    lag = (F.col("_j") - F.col("_n")).alias("_lag")
    if real:
        sums = [F.sum(F.col("x_v") * F.col("y_v")).alias("v")]
    else:
        xr, xi, yr, yi = (F.col(c) for c in ("x_re", "x_im", "y_re", "y_im"))
        sums = [F.sum(xr * yr + xi * yi).alias("re"), F.sum(xi * yr - xr * yi).alias("im")]
    found = a.join(b, same).groupBy(*keys, lag).agg(*sums)
    lags = sizes.select(*keys, (F.explode(F.sequence(F.lit(0), F.col("_nx") + F.col("_ny") - 2))).alias(position), "_ny").withColumn("_lag", F.col(position) - F.col("_ny") + 1)
    return lags.join(found, [*keys, "_lag"], "left").select(*keys, position, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in cols))


def _shift(rate: float, frequency: Column, position: Column) -> tuple[Column, Column]:
    angle = 2 * math.pi * frequency * position / rate
    return F.cos(angle), F.sin(angle)


def caf_maps(ref: DataFrame, surv: DataFrame, keys: Sequence[str], bins: int, start: float, step: float, rate: float, ranges: int) -> DataFrame:
    """The cross-ambiguity magnitudes of caf(), one row a series: array v of bins times ranges cells."""
    f = start + step * np.arange(bins)

    def run(re, im, s_re, s_im):
        out = []
        for p, q, u, v in zip(re, im, s_re, s_im):
            n = min(len(p), len(u))  # samples that both have
            turned = (p[:n] + 1j * q[:n]) * np.exp(2j * np.pi * np.outer(f, np.arange(n)) / rate)
            later = np.conj(u[:n] + 1j * v[:n])
            size = _transform_size(n + ranges)
            if ranges <= 4 * np.log2(size):  # few ranges take fewer products directly
                shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([later, np.zeros(ranges - 1)]), ranges)
                c = turned @ shifted
            else:
                c = np.fft.ifft(np.conj(np.fft.fft(turned, size)) * np.fft.fft(np.conj(later), size))[:, :ranges]
                c[:, n:] = 0
            out.append(np.abs(c).ravel())
        return [out]

    return map_arrays(_beside(ref, surv, keys, ["re", "im"]), keys, ["x_re", "x_im", "y_re", "y_im"], run, ["v"])


def caf(ref: DataFrame, surv: DataFrame, keys: Sequence[str], bins: int, start: float, step: float, rate: float, ranges: int, strategy: str = "auto") -> DataFrame:
    """Cross-ambiguity magnitude: |sum of ref[i] e^(+j 2 pi f i / rate) conj(surv[i + r])| for each Doppler bin d and range r.

    f is start + d * step. Only samples that both signals have count; ranges without overlap are 0.
    "arrow" (and "auto") works on whole series with NumPy, "relational" joins on the shifted position,
    for series that no task holds.
    """
    if _chosen(strategy) == "arrow":
        maps = caf_maps(ref, surv, keys, bins, start, step, rate, ranges)
        return maps.select(*keys, F.posexplode("v").alias("_k", "v")).select(*keys, F.expr(f"_k div {ranges}").cast("int").alias("d"), (F.col("_k") % ranges).alias("r"), "v")
    a = ref.select(*keys, F.col("i").cast("int").alias("i"), "re", "im")
    b = surv.select(*keys, F.col("i").cast("int").alias("i"), F.col("re").alias("s_re"), F.col("im").alias("s_im"))
    both = a.join(b, [*keys, "i"])  # positions below the shorter length
    c, s = _shift(rate, F.lit(float(start)) + F.col("d") * float(step), F.col("i"))
    turned = both.select(*keys, "i", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("d"), "re", "im")
    turned = turned.select(*keys, "i", "d", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
    later = both.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("r"), F.col("i").alias("_j"), "s_re", "s_im").withColumn("i", F.col("_j") - F.col("r")).where("i >= 0")
    pairs = turned.join(later, [*keys, "i"])
    sums = pairs.groupBy(*keys, "d", "r").agg(F.sum(F.col("re") * F.col("s_re") + F.col("im") * F.col("s_im")).alias("_re"), F.sum(F.col("im") * F.col("s_re") - F.col("re") * F.col("s_im")).alias("_im"))
    cells = both.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("d")).select(*keys, "d", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("r"))
    return cells.join(sums, [*keys, "d", "r"], "left").select(*keys, "d", "r", F.coalesce(F.hypot("_re", "_im"), F.lit(0.0)).alias("v"))


def _frames(window, guard: int, reference: int):
    return window.rowsBetween(-(guard + reference), -(guard + 1)), window.rowsBetween(guard + 1, guard + reference)


def ca_cfar(df: DataFrame, keys: Sequence[str], guard: int, reference: int, factor: float, position: str = "i", value: str = "v") -> DataFrame:
    """Cell-averaging detector: threshold factor * mean of the training cells at distance guard + 1 to guard + reference.

    Cells outside the series do not count; without training cells the threshold is 0. Detection is value > threshold.
    The sum is multiplied before it is divided, as in SQL from left to right: the quotient's rounding decides at ties.
    """
    frames = _frames(Window.partitionBy(*keys, "_piece").orderBy(position), guard, reference) if reference > 0 else ()
    total, count = F.lit(0.0), F.lit(0)
    for f in frames:
        total, count = total + F.coalesce(F.sum(value).over(f), F.lit(0.0)), count + F.count(value).over(f)
    threshold = F.coalesce(F.try_divide(F.lit(float(factor)) * total, count), F.lit(0.0))
    cut = in_pieces(df.select(*keys, position, value), position, guard + reference, guard + reference)
    x = cut.select(*keys, position, "_own", F.col(value).alias("v"), threshold.alias("threshold")).where("_own").drop("_own")
    return x.withColumn("det", (F.col("v") > F.col("threshold")).cast("int"))


def os_cfar(df: DataFrame, keys: Sequence[str], guard: int, reference: int, rank: int, factor: float, position: str = "i", value: str = "v") -> DataFrame:
    """Ordered-statistic detector: threshold factor * the training cell of 0-based rank (at most the last one); none without training cells."""
    frames = _frames(Window.partitionBy(*keys, "_piece").orderBy(position), guard, reference) if reference > 0 else ()
    cells = F.array_sort(F.concat(*(F.collect_list(value).over(f) for f in frames))) if frames else F.array().cast("array<double>")
    cut = in_pieces(df.select(*keys, position, value), position, guard + reference, guard + reference)
    x = cut.select(*keys, position, "_own", F.col(value).alias("v"), cells.alias("_cells")).where("_own")
    chosen = F.get("_cells", F.least(F.lit(rank), F.size("_cells") - 1))
    x = x.select(*keys, position, "v", F.coalesce(F.lit(float(factor)) * chosen, F.lit(0.0)).alias("threshold"), (F.size("_cells") > 0).alias("_some"))
    return x.withColumn("det", (F.col("_some") & (F.col("v") > F.col("threshold"))).cast("int")).drop("_some")


def ca_cfar_2d(grid: DataFrame, guard: tuple[int, int], reference: tuple[int, int], factor: float, keys: Sequence[str] = ("g",)) -> DataFrame:
    """Cell-averaging detector on dense grids: the outer box without the guard box, both clipped to the map."""
    across = Window.partitionBy(*keys, "d").orderBy("r")
    down = Window.partitionBy(*keys, "r").orderBy("d")
    (gd, gr), (rd, rr) = guard, reference
    x = grid.select(*keys, "d", "r", "v")
    for name, reach in (("o", gr + rr), ("g", gr)):
        frame = across.rangeBetween(-reach, reach)
        x = x.withColumns({f"_{name}s": F.sum("v").over(frame), f"_{name}n": F.count("v").over(frame)})
    for name, reach in (("o", gd + rd), ("g", gd)):
        frame = down.rangeBetween(-reach, reach)
        x = x.withColumns({f"_{name}S": F.sum(f"_{name}s").over(frame), f"_{name}N": F.sum(f"_{name}n").over(frame)})
    mean = F.try_divide(F.col("_oS") - F.col("_gS"), F.col("_oN") - F.col("_gN"))
    out = x.select(*keys, "d", "r", "v", F.coalesce(F.lit(float(factor)) * mean, F.lit(0.0)).alias("threshold"))
    return out.withColumn("det", (F.col("v") > F.col("threshold")).cast("int"))


def box_sums(x: np.ndarray, down: int, across: int) -> np.ndarray:
    """Sums of a grid over the box of `down` rows and `across` columns on each side of every cell, clipped to the grid."""
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    total[1:, 1:] = x.cumsum(0).cumsum(1)
    d, r = np.arange(x.shape[0])[:, None], np.arange(x.shape[1])
    top, bottom = np.maximum(d - down, 0), np.minimum(d + down + 1, x.shape[0])
    left, right = np.maximum(r - across, 0), np.minimum(r + across + 1, x.shape[1])
    return total[bottom, right] - total[top, right] - total[bottom, left] + total[top, left]


def grid_thresholds(x: np.ndarray, guard: tuple[int, int], reference: tuple[int, int], factor: float) -> np.ndarray:
    """Thresholds of ca_cfar_2d() for one grid as an array."""
    (gd, gr), (rd, rr) = guard, reference
    sums, counts = (box_sums(v, gd + rd, gr + rr) - box_sums(v, gd, gr) for v in (x, np.ones_like(x)))
    return np.where(counts > 0, factor * sums / np.maximum(counts, 1), 0.0)


def map_peaks(maps: DataFrame, keys: Sequence[str], ranges: int, guard: tuple[int, int], reference: tuple[int, int], factor: float, top: int) -> DataFrame:
    """The `top` strongest detections (rank, d, r, v) of each map (array v of cells, `ranges` a row), by ca_cfar_2d()."""

    def run(maps):
        out: list[list[np.ndarray]] = [[], [], [], []]
        for v in maps:
            x = v.reshape(-1, ranges)
            d, r = np.nonzero(x > grid_thresholds(x, guard, reference, factor))
            first = np.lexsort((r, d, -np.round(x[d, r], 6)))[:top]
            for o, c in zip(out, (np.arange(1, len(first) + 1), d[first], r[first], x[d[first], r[first]])):
                o.append(c.astype(float))
        return out

    found = map_arrays(maps, keys, ["v"], run, ["rank", "d", "r", "v"])
    rows = found.select(*keys, F.explode(F.arrays_zip("rank", "d", "r", "v")).alias("x"))
    return rows.select(*keys, *(F.col(f"x.{c}").cast("int").alias(c) for c in ("rank", "d", "r")), F.col("x.v").alias("v"))


def run_nlms(x: np.ndarray, ref: np.ndarray, sizes: np.ndarray, length: int, mu: float, eps: float, warmup: str = "passthrough", state: dict | None = None) -> np.ndarray:
    """Normalised least mean squares on real or complex rows side by side; state holds weights and the last references."""
    n, steps = x.shape
    state = state if state is not None else {}
    w = state.setdefault("w", np.zeros((n, length), x.dtype))
    u = state.setdefault("u", np.zeros((n, length), x.dtype))
    seen = state.setdefault("seen", np.zeros(n, np.int64))
    y = x.copy()
    for t in range(steps):
        live = t < sizes
        u[live] = np.concatenate([ref[live, t, None], u[live, :-1]], axis=1)
        seen[live] += 1
        adapt = live & ((seen >= length) if warmup == "passthrough" else True)
        if not adapt.any():
            continue
        a = u[adapt]
        e = x[adapt, t] - (w[adapt] * a).sum(1)
        w[adapt] += (mu * e / (eps + (a * np.conj(a)).real.sum(1)))[:, None] * np.conj(a)
        y[adapt, t] = e
    return y


def nlms(df: DataFrame, keys: Sequence[str], length: int, mu: float, eps: float = 1e-6, position: str = "i", value: str = "v", reference: str = "ref", warmup: str = "passthrough") -> DataFrame:
    """Residual of predicting value from the last `length` references.

    With warmup "passthrough" the first length - 1 samples (all, if the filter is longer than the
    series) pass through; with "grow" adaptation starts at once on a growing history.
    """

    def run(x, ref):
        a, sizes = padded(x)
        return [unpadded(run_nlms(a, padded(ref)[0], sizes, length, mu, eps, warmup), sizes)]

    return per_series(df, keys, position, [value, reference], run, ["v"])


def nlms_complex(df: DataFrame, keys: Sequence[str], length: int, mu: float, eps: float = 1e-6, position: str = "i", warmup: str = "passthrough") -> DataFrame:
    """nlms() of complex samples (re, im) and references (ref_re, ref_im); weights step along the conjugate references."""

    def run(re, im, ref_re, ref_im):
        (a, sizes), b, c, d = padded(re), padded(im)[0], padded(ref_re)[0], padded(ref_im)[0]
        y = run_nlms(a + 1j * b, c + 1j * d, sizes, length, mu, eps, warmup)
        return [unpadded(y.real, sizes), unpadded(y.imag, sizes)]

    return per_series(df, keys, position, ["re", "im", "ref_re", "ref_im"], run, ["re", "im"])


def project_out(df: DataFrame, basis: DataFrame, keys: Sequence[str], position: str = "i", value: str = "v") -> DataFrame:
    """x minus its components along the orthonormal basis vectors (c, i, u)."""
    parts = df.join(basis, position).groupBy(*keys, "c").agg(F.sum(F.col(value) * F.col("u")).alias("_w"))
    back = parts.join(basis, "c").groupBy(*keys, position).agg(F.sum(F.col("_w") * F.col("u")).alias("_p"))
    return df.join(back, [*keys, position], "left").select(*keys, position, (F.col(value) - F.coalesce("_p", F.lit(0.0))).alias("v"))


def orthonormal(basis: DataFrame) -> DataFrame:
    """An orthonormal basis (c, i, u) of the span of basis vectors, for projections in general position; one bounded matrix."""

    def run(table):
        i, c = table.column("i").to_numpy(), table.column("c").to_numpy()
        x = np.zeros((int(i.max()) + 1, int(c.max()) + 1))
        x[i, c] = table.column("u").to_numpy()
        q, s, _ = np.linalg.svd(x, full_matrices=False)
        q = q[:, s > s.max(initial=0) * 1e-12]
        import pyarrow as pa

        ii, cc = np.indices(q.shape)
        return pa.table({"c": pa.array(cc.ravel().astype(np.int32)), "i": pa.array(ii.ravel().astype(np.int32)), "u": pa.array(q.ravel())})

    ship(basis.sparkSession)
    return basis.select(F.lit(0).alias("_one"), F.col("c").cast("int").alias("c"), F.col("i").cast("int").alias("i"), F.col("u").cast("double").alias("u")).groupBy("_one").applyInArrow(run, "c int, i int, u double")


def mti(grid: DataFrame, coefficients: Sequence[float]) -> DataFrame:
    """Moving-target indication: sums over successive pulses of grids (g, p, r, v), valid part, no flip."""
    from .filtering import fir

    return fir(grid, ["g", "r"], coefficients, "p").select("g", "p", "r", "v")


def delay_and_sum(channels: DataFrame, steering: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Beam of channels (ch, t, v) with steering (ch, delay, w): out[t] is the sum of w times x[t - delay], zeros outside."""
    n = channels.groupBy(*keys).agg(F.max("t").alias("_last")) if keys else channels.agg(F.max("t").alias("_last"))
    spread = channels.join(steering, "ch").select(*keys, (F.col("t") + F.col("delay")).cast("int").alias("t"), (F.col("w") * F.col("v")).alias("v"))
    zeros = n.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_last").cast("int"))).alias("t"), F.lit(0.0).alias("v"))
    sums = spread.unionByName(zeros).groupBy(*keys, "t").agg(F.sum("v").alias("v"), F.max(F.col("v") * 0).alias("_"))
    inside = zeros.select(*keys, "t")
    return sums.join(inside, [*keys, "t"], "left_semi").select(*keys, "t", "v")


def phase_and_sum(channels: DataFrame, steering: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Beam of complex channels (ch, t, re, im) with steering (ch, phase, w): the sum of w e^(j phase) x."""
    c, s = F.cos("phase"), F.sin("phase")
    turned = channels.join(steering, "ch").select(*keys, "t", (F.col("w") * (F.col("re") * c - F.col("im") * s)).alias("re"), (F.col("w") * (F.col("re") * s + F.col("im") * c)).alias("im"))
    return turned.groupBy(*keys, "t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def steering_phase(element: Column, spacing: float, degrees: Column, sign: int = 1) -> Column:
    """Phase of a uniform linear array's element (spacing in wavelengths) for a direction."""
    return F.lit(sign * 2 * math.pi * spacing) * F.sin(F.radians(degrees)) * element


def bartlett(snapshot: DataFrame, keys: Sequence[str], spacing: float, angles: int) -> DataFrame:
    """|a^H x|^2 over angles from -90 to 90 degrees (inclusive) of snapshots (ch, re, im), not normalised."""
    step = 180.0 / (angles - 1) if angles > 1 else 0.0
    spread = snapshot.select(*keys, "ch", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("a"))
    p = steering_phase(F.col("ch"), spacing, F.lit(-90.0) + F.col("a") * step, -1)
    c, s = F.cos(p), F.sin(p)
    sums = spread.groupBy(*keys, "a").agg(F.sum(F.col("re") * c + F.col("im") * s).alias("_re"), F.sum(F.col("im") * c - F.col("re") * s).alias("_im"))
    return sums.select(*keys, "a", (F.lit(-90.0) + F.col("a") * step).alias("angle"), (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("power"))
