import numpy as np
import pytest

from helpers import arrays, cells, csignal, grid, signal
from sigmaframe.operators import radar as X

R = np.random.default_rng(3)


def slow_xcorr(x, y):
    return np.array([sum(x[n] * np.conj(y[n + k - len(y) + 1]) for n in range(len(x)) if 0 <= n + k - len(y) + 1 < len(y)) for k in range(len(x) + len(y) - 1)])


@pytest.mark.parametrize("sizes", [(5, 5), (9, 3), (2, 11)])
def test_xcorr(spark, sizes):
    x, y = (R.normal(size=n) for n in sizes)
    assert arrays(X.xcorr(signal(spark, [x]), signal(spark, [y]), ["series"]))[0] == pytest.approx(slow_xcorr(x, y))
    zx, zy = (R.normal(size=n) + 1j * R.normal(size=n) for n in sizes)
    got = arrays(X.xcorr(csignal(spark, [zx]), csignal(spark, [zy]), ["series"]), "series", "i", "re", "im")[0]
    assert got[:, 0] + 1j * got[:, 1] == pytest.approx(slow_xcorr(zx, zy))


@pytest.mark.parametrize("strategy", ["relational", "arrow"])
def test_caf(spark, strategy):
    n, rate, delay, shift = 64, 1000.0, 4, 30.0
    ref = R.normal(size=n) + 1j * R.normal(size=n)
    surv = np.zeros(n, complex)
    surv[delay:] = ref[:-delay]
    surv *= np.exp(2j * np.pi * shift * np.arange(n) / rate)
    got = cells(X.caf(csignal(spark, [ref]), csignal(spark, [surv[:60]]), ["series"], 7, -30.0, 15.0, rate, 70, strategy), 0, "d", "r", "series")
    want = np.zeros((7, 70))
    for d in range(7):
        turned = ref[:60] * np.exp(2j * np.pi * (-30 + 15 * d) * np.arange(60) / rate)
        for r in range(60):
            want[d, r] = abs(sum(turned[i] * np.conj(surv[i + r]) for i in range(60 - r)))
    assert got == pytest.approx(want, abs=1e-9)
    assert np.unravel_index(got.argmax(), got.shape) == (4, delay)


def test_detectors_find_a_target(spark):
    x = np.abs(np.random.default_rng(42).normal(size=128))
    x[64] = 100
    df = signal(spark, [x])
    for found in (X.ca_cfar(df, ["series"], 2, 8, 10), X.os_cfar(df, ["series"], 2, 8, 11, 10)):
        hits = [r.i for r in found.where("det = 1").collect()]
        assert 64 in hits and len(hits) <= 5


def test_detectors_without_training_cells(spark):
    df = signal(spark, [[1.0]])
    assert [(r.threshold, r.det) for r in X.ca_cfar(df, ["series"], 0, 2, 3).collect()] == [(0, 1)]
    assert [(r.threshold, r.det) for r in X.os_cfar(df, ["series"], 0, 2, 0, 3).collect()] == [(0, 0)]


def test_cfar_thresholds(spark):
    x, g, n = R.exponential(size=30), 1, 3
    got = arrays(X.ca_cfar(signal(spark, [x]), ["series"], g, n, 2.0), "series", "i", "threshold")[0]
    os = arrays(X.os_cfar(signal(spark, [x]), ["series"], g, n, 4, 2.0), "series", "i", "threshold")[0]
    for i in range(30):
        cell = [x[j] for j in range(30) if g < abs(i - j) <= g + n]
        assert got[i] == pytest.approx(2 * np.mean(cell))
        assert os[i] == pytest.approx(2 * sorted(cell)[min(4, len(cell) - 1)])


def test_cfar_tie_is_no_detection(spark):
    """At position 2 the five training cells sum up to 130.45: three times their mean is 78.27, the value there."""
    x = [10.0, 0.0, 78.27, 0.0, 30.0, 30.45, 30.0, 30.0, 0.0, 0.0]
    found = {r.i: r for r in X.ca_cfar(signal(spark, [x]), ["series"], 1, 4, 3).collect()}
    assert (found[2].threshold, found[2].det) == (78.27, 0)


def test_two_dimensional_detector(spark):
    a = np.full((16, 16), 0.1)
    a[4, 9] = a[12, 2] = 10
    got = X.ca_cfar_2d(grid(spark, a), (1, 1), (3, 3), 5)
    assert {(r.d, r.r) for r in got.where("det = 1").collect()} == {(4, 9), (12, 2)}
    t = cells(got.select("g", "d", "r", got.threshold.alias("v")), 0, "d", "r", "g")
    box = lambda i, j, h: [(p, q) for p in range(max(0, i - h), min(16, i + h + 1)) for q in range(max(0, j - h), min(16, j + h + 1))]
    for i, j in ((0, 0), (5, 8), (15, 3)):
        cell = set(box(i, j, 4)) - set(box(i, j, 1))
        assert t[i, j] == pytest.approx(5 * np.mean([a[c] for c in cell]))


def slow_nlms(x, ref, n, mu, eps):
    w, y = np.zeros(n), x.copy()
    for t in range(n - 1, len(x)):
        u = ref[t - n + 1 : t + 1][::-1]
        e = x[t] - w @ u
        w += mu * e / (eps + u @ u) * u
        y[t] = e
    return y


def test_nlms(spark):
    t = np.arange(256)
    ref = np.sin(0.1 * t)
    x = ref + 5 * (t == 128)
    df = signal(spark, [x, x[:8]]).join(signal(spark, [ref, ref[:8]], "ref"), ["series", "i"])
    got = arrays(X.nlms(df, ["series"], 16, 0.1))
    assert got[0] == pytest.approx(slow_nlms(x, ref, 16, 0.1, 1e-6)) and got[1] == pytest.approx(x[:8])
    assert abs(got[0][128]) > 2 * np.abs(np.delete(got[0][64:], 64)).mean()


def test_projection(spark):
    q = np.linalg.qr(R.normal(size=(10, 2)))[0]
    x = R.normal(size=10)
    basis = spark.createDataFrame([(c, i, float(q[i, c])) for c in range(2) for i in range(10)], "c int, i int, u double")
    assert arrays(X.project_out(signal(spark, [x]), basis, ["series"]))[0] == pytest.approx(x - q @ (q.T @ x))
    general = spark.createDataFrame([(c, i, float(v)) for (i, c), v in np.ndenumerate(q @ np.array([[1.0, 2.0], [0.5, -3.0]]))], "c int, i int, u double")
    assert arrays(X.project_out(signal(spark, [x]), X.orthonormal(general), ["series"]))[0] == pytest.approx(x - q @ (q.T @ x))


def test_mti_and_beams(spark):
    a = R.normal(size=(6, 3))
    g = grid(spark, a).withColumnRenamed("d", "p")
    assert cells(X.mti(g, [1.0, -1.0]), 0, "p", "r", "g") == pytest.approx(a[:-1] - a[1:])
    assert X.mti(g, [1.0] * 9).count() == 0
    x = R.normal(size=(3, 8))
    ch = spark.createDataFrame([(c, t, float(v)) for (c, t), v in np.ndenumerate(x)], "ch int, t int, v double")
    steer = spark.createDataFrame([(0, 0, 1.0), (1, 2, 0.5), (2, -3, 2.0)], "ch int, delay int, w double")
    got = [r.v for r in X.delay_and_sum(ch, steer).orderBy("t").collect()]
    want = [sum(w * x[c, t - d] for c, d, w in ((0, 0, 1.0), (1, 2, 0.5), (2, -3, 2.0)) if 0 <= t - d < 8) for t in range(8)]
    assert got == pytest.approx(want)


def test_bartlett_points_at_the_source(spark):
    angle = 20.0
    z = np.exp(-2j * np.pi * 0.5 * np.sin(np.radians(angle)) * np.arange(8))
    snap = spark.createDataFrame([(0, c, float(v.real), float(v.imag)) for c, v in enumerate(z)], "k int, ch int, re double, im double")
    best = X.bartlett(snap, ["k"], 0.5, 181).orderBy("power", ascending=False).first()
    assert best.angle == pytest.approx(angle) and best.power == pytest.approx(64)
