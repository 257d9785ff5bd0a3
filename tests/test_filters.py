import math

import numpy as np
import pytest

from helpers import arrays, cells, csignal, grid, signal
from sigmaframe.operators import filtering as D
from sigmaframe.operators import spectral as S

R = np.random.default_rng(7)


def test_fir_and_convolutions(spark):
    x, h = [R.normal(size=20), R.normal(size=2)], [0.25, -0.5, 1.0]
    df = signal(spark, x)
    got = arrays(D.fir(df, ["series"], h))
    assert got[0] == pytest.approx(np.correlate(x[0], h, "valid")) and 1 not in got
    assert arrays(D.convolve_valid(df, ["series"], h))[0] == pytest.approx(np.convolve(x[0], h, "valid"))
    full = arrays(D.convolve_full(df, ["series"], h))
    assert full[0] == pytest.approx(np.convolve(x[0], h)) and full[1] == pytest.approx(np.convolve(x[1], h))


def slow2d(a, k):
    h, w = np.array(k).shape
    return np.array([[(a[i : i + h, j : j + w] * k).sum() for j in range(a.shape[1] - w + 1)] for i in range(a.shape[0] - h + 1)])


def test_two_dimensional(spark):
    a, k = R.normal(size=(7, 9)), R.normal(size=(3, 2))
    g = grid(spark, a)
    c = lambda d: cells(d, 0, "d", "r", "g")
    assert c(D.correlate2d(g, k.tolist())) == pytest.approx(slow2d(a, k))
    assert c(D.convolve2d(g, k.tolist())) == pytest.approx(slow2d(a, k[::-1, ::-1]))
    col, row = [1.0, 2.0, -1.0], [0.5, 0.25]
    assert c(D.separable2d(g, col, row)) == pytest.approx(slow2d(a, np.outer(col, row)))


def loop_resample(x, h, up, down):
    n = math.ceil(len(x) * up / down)
    return [sum(x[i - k] * h[p + k * up] for k in range(len(h)) if i - k >= 0 and p + k * up < len(h)) for m in range(n) for i, p in [divmod(m * down, up)]]


@pytest.mark.parametrize("up,down", [(1, 1), (2, 1), (3, 2), (2, 5), (1, 3)])
def test_resample(spark, up, down):
    x, h = [R.normal(size=17), R.normal(size=1)], list(R.normal(size=7))
    got = arrays(D.resample(signal(spark, x), ["series"], h, up, down))
    for k in (0, 1):
        assert np.atleast_1d(got[k]) == pytest.approx(loop_resample(x[k], h, up, down))


def test_resample_rejects_bad_rates(spark):
    assert D.resample(signal(spark, [[1.0]]), ["series"], [1.0], 0, 1).count() == 0


def loop_biquad(x, c):
    s1 = s2 = 0.0
    out = []
    for v in x:
        y = c.b0 * v + s1
        s1, s2 = c.b1 * v - c.a1 * y + s2, c.b2 * v - c.a2 * y
        out.append(y)
    return out


def test_biquad(spark):
    from pyspark.sql import functions as F

    from sigmaframe.schema import to_arrays, to_rows

    c, n = D.design("lowpass", 1000, 48000), D.design("notch", 5000, 48000, 3)
    x = [R.normal(size=40), R.normal(size=13)]
    df = signal(spark, x)
    got = arrays(D.biquad(df, ["series"], c))
    both = arrays(D.biquad(df, ["series"], [c, n]))
    for k in (0, 1):
        assert got[k] == pytest.approx(loop_biquad(x[k], c))
        assert both[k] == pytest.approx(loop_biquad(loop_biquad(x[k], c), n))
    fold = to_rows(to_arrays(df, ["series"], "i", ["v"]).withColumn("v", D.biquad_fold(F.col("v"), c)), ["series"], "i", ["v"])
    assert arrays(fold)[0] == pytest.approx(loop_biquad(x[0], c))
    step = arrays(D.biquad(signal(spark, [np.ones(2000)]), ["series"], [c, c]))[0]
    assert step[-1] == pytest.approx(1, abs=0.01)


def test_design_of_bad_parameters_passes_through():
    for bad in (("lowpass", 0, 48000), ("lowpass", 30000, 48000), ("notch", 10, -1), ("bandpass", 10, 100, 0)):
        assert D.design(*bad) == D.Biquad(ok=False)


def test_transforms(spark):
    x = [R.normal(size=10) + 1j * R.normal(size=10), R.normal(size=7) + 1j * R.normal(size=7)]
    df = csignal(spark, x)
    pair = lambda d: {k: v[:, 0] + 1j * v[:, 1] for k, v in arrays(d, "series", "i", "re", "im").items()}
    forward = S.fft(df, ["series"])
    for k in (0, 1):
        assert pair(forward)[k] == pytest.approx(np.fft.fft(x[k]))
        assert pair(S.fft(forward, ["series"], inverse=True))[k] == pytest.approx(x[k])
        assert pair(S.fft(df, ["series"], inverse=True, norm="none"))[k] == pytest.approx(np.fft.ifft(x[k]) * len(x[k]))
    assert pair(S.dft_join(df.where("series = 0"), ["series"], 10))[0] == pytest.approx(np.fft.fft(x[0]))
    real = signal(spark, [x[0].real])
    half = S.rfft(real, ["series"])
    assert pair(half)[0] == pytest.approx(np.fft.rfft(x[0].real))
    assert arrays(S.irfft(half, ["series"], 10))[0] == pytest.approx(x[0].real)


@pytest.mark.parametrize("size", [3, 6, 9])
def test_doppler_folds_and_pads(spark, size):
    z = R.normal(size=(6, 4)) + 1j * R.normal(size=(6, 4))
    rows = [(0, p, r, float(v.real), float(v.imag)) for (p, r), v in np.ndenumerate(z)]
    got = S.doppler(spark.createDataFrame(rows, "g int, p int, r int, re double, im double"), size).collect()
    want = np.array([[sum(z[p, r] * np.exp(-2j * np.pi * d * p / size) for p in range(6)) for r in range(4)] for d in range(size)])
    assert len(got) == size * 4 and all(complex(x.re, x.im) == pytest.approx(want[x.d, x.r]) for x in got)


def test_windows(spark):
    w = lambda *a: np.array([r.w for r in S.window(spark, *a).orderBy("i").collect()])
    assert w(16, "hamming") == pytest.approx(np.hamming(16)) and w(16, "hann") == pytest.approx(np.hanning(16))
    assert w(16, "blackman") == pytest.approx(np.blackman(16), abs=1e-12) and w(16, "kaiser", 5.0) == pytest.approx(np.kaiser(16, 5))
    assert w(1, "hann") == pytest.approx([1.0]) and len(w(0, "hann")) == 0
    t = w(21, "tukey", 0.5)
    assert t == pytest.approx(t[::-1]) and t[10] == 1 and t[0] == pytest.approx(0)


def test_long_series_are_cut_by_position(spark, monkeypatch):
    from sigmaframe import schema
    from sigmaframe.operators import radar, reduce

    x = np.random.default_rng(6).normal(size=500)
    df = signal(spark, [x, x[:3], x[:41]])
    run = {"fir": lambda: D.fir(df, ["series"], [0.5, -1.0, 2.0]), "ca": lambda: radar.ca_cfar(df, ["series"], 1, 3, 2.0), "os": lambda: radar.os_cfar(df, ["series"], 1, 3, 2, 2.0), "scan": lambda: reduce.prefix_sum(df, ["series"])}
    whole = {k: sorted(map(tuple, f().collect())) for k, f in run.items()}
    monkeypatch.setattr(schema, "PIECE", 10)
    run["scan"] = lambda: reduce.prefix_sum(df, ["series"], length=10)
    for k, f in run.items():
        got = sorted(map(tuple, f().collect()))
        assert len(got) == len(whole[k]) and np.allclose(np.array(got, float), np.array(whole[k], float)), k


@pytest.mark.parametrize("inverse", [False, True])
def test_fft2_of_a_shape(spark, inverse):
    a = R.normal(size=(7, 9)) + 1j * R.normal(size=(7, 9))
    rows = [(0, d, r, float(z.real), float(z.imag)) for (d, r), z in np.ndenumerate(a) if d not in (0, 3) and (d, r) != (2, 4)]
    a[[0, 3]], a[2, 4] = 0, 0
    folded = np.zeros((4, 12), complex)
    np.add.at(folded, (np.arange(7) % 4,), np.pad(a, ((0, 0), (0, 3))))
    df = spark.createDataFrame(rows, "g int, d int, r int, re double, im double")
    for shape, whole in (((10, 16), np.pad(a, ((0, 3), (0, 7)))), ((4, 12), folded)):
        got = np.zeros(shape, complex)
        found = S.fft2(df, inverse, shape=shape).collect()
        for x in found:
            got[x.d, x.r] = x.re + 1j * x.im
        want = np.fft.ifft2(whole) * whole.size if inverse else np.fft.fft2(whole)
        assert len(found) == got.size and got == pytest.approx(want)


def test_doppler_window_of_a_count(spark):
    z = R.normal(size=(6, 2)) + 1j * R.normal(size=(6, 2))
    rows = [(0, p, r, float(v.real), float(v.imag)) for (p, r), v in np.ndenumerate(z)]
    df = spark.createDataFrame(rows, "g int, p int, r int, re double, im double")
    for count, w in ((10, np.hamming(10)[:6]), (4, np.append(np.hamming(4), [1, 1])), (1, np.ones(6)), (None, np.hamming(6))):
        got = S.doppler(df, 8, "hamming", count).collect()
        want = np.fft.fft(z * w[:, None], 8, axis=0)
        assert len(got) == 16 and all(complex(x.re, x.im) == pytest.approx(want[x.d, x.r]) for x in got)
