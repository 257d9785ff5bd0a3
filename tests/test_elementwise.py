import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import arrays, csignal, signal
from sigmaframe.functions import complexnum as C
from sigmaframe.functions import vector as V
from sigmaframe.operators import reduce
from sigmaframe.schema import gaps, ingest, to_arrays, to_rows


def test_division_is_ieee(spark):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (6.0, 3.0), (float("nan"), 0.0)]
    rows = spark.createDataFrame(pairs, "a double, b double").select(V.div(F.col("a"), F.col("b")).alias("q")).collect()
    got = [r.q for r in rows]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == -math.inf and got[4] == 2 and math.isnan(got[5])


def test_safe_division_never_fails(spark):
    row = spark.createDataFrame([(1.0, 0.0), (1.0, -0.0), (1.0, -2.0)], "a double, b double").select(V.safe_div(F.col("a"), F.col("b")).alias("q")).collect()
    assert [r.q for r in row] == pytest.approx([1e10, 1e10, -0.5])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=20))
def test_activations(spark, values):
    x = np.array(values)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    v = F.col("v")
    got = np.array([list(r) for r in df.select(V.relu(v), V.leaky_relu(v, 0.1), V.sigmoid(v), V.tanh(v), V.gelu(v)).collect()])
    want = np.stack([np.maximum(x, 0), np.where(x > 0, x, 0.1 * x), 1 / (1 + np.exp(-x)), np.tanh(x), 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))], axis=1)
    assert got == pytest.approx(want, abs=1e-9)


def test_reductions(spark):
    x = signal(spark, [[3.0, -4.0, 0.0], [1e200, 1e200], [3e-200, 4e-200], [0.0]])
    norms = {r.series: r.norm for r in reduce.norm(x, ["series"]).collect()}
    assert norms[0] == pytest.approx(5) and norms[1] == pytest.approx(math.sqrt(2) * 1e200) and norms[2] == pytest.approx(5e-200) and norms[3] == 0
    scans = arrays(reduce.prefix_sum(x, ["series"]), "series", "i", "scan")
    assert list(scans[0]) == [0, 3, -1]
    soft = arrays(reduce.softmax(signal(spark, [[1.0, 2.0, 1000.0]]), ["series"]), "series", "i", "softmax")[0]
    assert soft.sum() == pytest.approx(1) and soft[2] == pytest.approx(1)
    one = reduce.extremes(x, ["series"]).where("series = 0").collect()[0]
    assert (one.max, one.min) == (3, -4)


def test_array_dot_of_unequal_lengths_is_zero(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    assert list(row.select(V.dot_arrays(F.col("a"), F.col("b")), V.dot_arrays(F.col("a"), F.col("c"))).collect()[0]) == [11, 0]


def test_complex(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=6) + 1j * r.normal(size=6)
    a = (F.col("re"), F.col("im"))
    df = csignal(spark, [x]).orderBy("i")
    got = df.select(*C.mul(a, a), *C.conj_mul(a, a), C.magnitude(a), C.phase(a), *C.scale(a, 2 - 1j), *C.unit(a[0])).collect()
    got = np.array([list(g) for g in got])
    want = np.stack([(x * x).real, (x * x).imag, abs(x) ** 2, 0 * x.real, abs(x), np.angle(x), (x * (2 - 1j)).real, (x * (2 - 1j)).imag, np.cos(x.real), np.sin(x.real)], axis=1)
    assert got == pytest.approx(want)
    flat = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "s array<double>").select(C.from_interleaved(F.col("s")).alias("z")).collect()[0].z
    assert [(z.re, z.im) for z in flat] == [(1, 2), (3, 4)]


def test_schema_checks(spark):
    good, bad = signal(spark, [[1.0, 2.0]]), signal(spark, [[1.0, 2.0, 3.0]]).where("i != 1")
    assert gaps(good, ["series"]).count() == 0 and gaps(bad, ["series"]).count() == 1
    with pytest.raises(Exception, match="null in column v"):
        ingest(spark.createDataFrame([(0, None)], "i int, v double"), ["i"], ["v"]).collect()
    assert sorted(to_rows(to_arrays(good, ["series"], "i", ["v"]), ["series"], "i", ["v"]).collect()) == sorted(good.collect())
