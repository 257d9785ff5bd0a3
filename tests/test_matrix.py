import numpy as np
import pytest

from helpers import cells, matrix
from sigmaframe.operators import linalg
from sigmaframe.operators import matrix as M
from sigmaframe.operators.batches import factor

R = np.random.default_rng(42)


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 19), (16, 15, 17), (33, 1, 8)])
def test_gemm(spark, shape):
    m, n, k = shape
    a, b = R.normal(size=(m, k)), R.normal(size=(k, n))
    assert cells(M.gemm(matrix(spark, a), matrix(spark, b))) == pytest.approx(a @ b)


def test_shape_mismatch_gives_no_rows(spark):
    assert M.gemm(matrix(spark, np.ones((2, 3))), matrix(spark, np.ones((2, 2)))).count() == 0


def test_accumulate_gemv_outer_add(spark):
    a, b, c = R.normal(size=(4, 4)), R.normal(size=(4, 4)), R.normal(size=(4, 4))
    A, B, X = matrix(spark, a), matrix(spark, b), matrix(spark, c)
    assert cells(M.gemm_accumulate(X, A, B)) == pytest.approx(c + a @ b)
    vec = matrix(spark, c[:, :1]).select("m", "i", "v")
    assert [r.v for r in M.gemv(A, vec).orderBy("i").collect()] == pytest.approx(a @ c[:, 0])
    assert cells(M.outer(vec, vec)) == pytest.approx(np.outer(c[:, 0], c[:, 0]))
    assert cells(M.add(A, B)) == pytest.approx(a + b)
    assert cells(M.sub(A, B)) == pytest.approx(a - b)
    assert cells(M.hadamard(A, B)) == pytest.approx(a * b)
    assert cells(M.scale(M.transpose(A), 2)) == pytest.approx(2 * a.T)


@pytest.mark.parametrize("shape", [(4, 4, 16), (13, 11, 3), (1, 1, 1)])
def test_int8_is_exact(spark, shape):
    m, n, k = shape
    a, b = R.integers(-128, 128, (m, k)), R.integers(-128, 128, (k, n))
    A, B = matrix(spark, a, kind="tinyint"), matrix(spark, b, kind="tinyint")
    assert (cells(M.gemm_int8(A, B)) == a @ b).all()
    assert cells(M.gemm_affine(A, B, 0.1, 3, 0.2, -5)) == pytest.approx(0.02 * ((a - 3) @ (b + 5)))


def spd(n):
    x = R.normal(size=(n, n))
    return x @ x.T + n * np.eye(n)


@pytest.mark.parametrize("n", [1, 3, 32])
def test_factorisations(spark, n):
    a, b = spd(n), R.normal(size=(n, 2))
    A, B = matrix(spark, a), matrix(spark, b)
    low = cells(factor(linalg.cholesky(A), "l"))
    assert low @ low.T == pytest.approx(a) and np.triu(low, 1) == pytest.approx(0)
    found = linalg.lu(A)
    packed, rows = cells(factor(found, "lu")), cells(factor(found, "piv"))[0].astype(int)
    assert (np.tril(packed, -1) + np.eye(n)) @ np.triu(packed) == pytest.approx(a[rows])
    for f in (linalg.solve, linalg.solve_spd):
        assert cells(factor(f(A, B), "x")) == pytest.approx(np.linalg.solve(a, b))
    assert cells(factor(linalg.inverse(A), "inverse")) == pytest.approx(np.linalg.inv(a))
    L = matrix(spark, low)
    assert cells(factor(linalg.cholesky_solve(L, B), "x")) == pytest.approx(np.linalg.solve(a, b))
    assert cells(factor(linalg.cholesky_inverse(L), "inverse")) == pytest.approx(np.linalg.inv(a))
    values = cells(factor(linalg.eigh(A), "values"))[0]
    assert values == pytest.approx(np.linalg.eigvalsh(a))


def test_qr_and_svd_of_a_tall_matrix(spark):
    a = R.normal(size=(12, 5))
    found = linalg.qr(matrix(spark, a))
    q, r = cells(factor(found, "q")), cells(factor(found, "r"))
    assert q @ r == pytest.approx(a) and q.T @ q == pytest.approx(np.eye(12))
    assert np.sign(r[0, 0]) == -np.sign(a[0, 0])
    found = linalg.svd(matrix(spark, a))
    assert cells(factor(found, "s"))[0] == pytest.approx(np.linalg.svd(a)[1])


@pytest.mark.parametrize("kind", linalg.TRIANGLES)
def test_triangular(spark, kind):
    a, b = spd(5), R.normal(size=(5, 3))
    t = {"lower": np.tril(a), "upper": np.triu(a), "lower_unit": np.tril(a, -1) + np.eye(5), "lower_transposed": np.tril(a).T}[kind]
    assert cells(factor(linalg.triangular_solve(matrix(spark, a), matrix(spark, b), kind), "x")) == pytest.approx(np.linalg.solve(t, b))


def test_failures_report_the_pivot(spark):
    bad = np.array([[1.0, 2.0], [2.0, 1.0]])
    assert [(r.info, r.factor) for r in linalg.cholesky(matrix(spark, bad)).collect()] == [(2, None)]
    assert [r.info for r in linalg.lu(matrix(spark, np.ones((3, 3)))).collect()] == [2]
    assert [r.info for r in linalg.solve(matrix(spark, np.ones((2, 2))), matrix(spark, np.ones((2, 1)))).collect()] == [2]
    assert [r.info for r in linalg.triangular_solve(matrix(spark, np.array([[0.0, 0.0], [1.0, 1.0]])), matrix(spark, np.ones((2, 1)))).collect()] == [1]
