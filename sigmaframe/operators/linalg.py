"""Dense factorisations and solvers, one matrix of a batch per NumPy call.

Failures follow one rule: `info` is the 1-based index of the failing pivot and the matrix has no
values. Cholesky reads the lower triangle only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .batches import per_matrix

TRIANGLES = ("lower", "upper", "lower_unit", "lower_transposed")


def substitute(t: np.ndarray, b: np.ndarray, kind: str) -> tuple[int, np.ndarray]:
    """Solves a triangular system for all right sides; info of the first zero on the diagonal."""
    if kind == "lower_transposed":
        t, kind = np.tril(t).T, "upper"
    n, x = len(t), b.astype(np.float64).copy()
    for k in range(n) if kind.startswith("lower") else range(n - 1, -1, -1):
        if kind != "lower_unit":
            if t[k, k] == 0:
                return k + 1, x
            x[k] /= t[k, k]
        rest = slice(k + 1, n) if kind.startswith("lower") else slice(0, k)
        x[rest] -= np.outer(t[rest, k], x[k]) if x.ndim == 2 else t[rest, k] * x[k]
    return 0, x


def triangular_solve(t: DataFrame, b: DataFrame, kind: str = "lower") -> DataFrame:
    """x of t x = b for a batch; b may have several columns. Only the named triangle is read."""
    if kind not in TRIANGLES:
        raise ValueError(f"kind must be one of {TRIANGLES}")

    def run(t: np.ndarray, b: np.ndarray):
        info, x = substitute(t, b, kind)
        return info, {"x": x}

    return per_matrix(t, run, b)


def _lower(a: np.ndarray) -> tuple[int, np.ndarray]:
    n, low = len(a), np.tril(a).astype(np.float64)
    for k in range(n):
        pivot = low[k, k] - low[k, :k] @ low[k, :k]
        if not pivot > 0:
            return k + 1, low
        low[k, k] = np.sqrt(pivot)
        low[k + 1 :, k] = (low[k + 1 :, k] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
    return 0, low


def cholesky(a: DataFrame) -> DataFrame:
    """L with a = L L^T."""

    def run(a: np.ndarray):
        info, low = _lower(a)
        return info, {"l": low}

    return per_matrix(a, run)


def eliminate(a: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Packed L\\U with partial pivoting, and for each row the source row."""
    x, rows = a.astype(np.float64).copy(), np.arange(len(a))
    for k in range(min(x.shape)):
        best = k + int(np.abs(x[k:, k]).argmax())
        if x[best, k] == 0:
            return k + 1, x, rows
        if best != k:
            x[[k, best]], rows[[k, best]] = x[[best, k]], rows[[best, k]]
        x[k + 1 :, k] /= x[k, k]
        x[k + 1 :, k + 1 :] -= np.outer(x[k + 1 :, k], x[k, k + 1 :])
    return 0, x, rows


def lu(a: DataFrame) -> DataFrame:
    """Factors lu (packed) and piv (row permutation as one row of source rows)."""

    def run(a: np.ndarray):
        info, x, rows = eliminate(a)
        return info, {"lu": x, "piv": rows}

    return per_matrix(a, run)


def qr(a: DataFrame) -> DataFrame:
    """Full Q and R by Householder reflections; a diagonal entry of R has the sign opposite to its column's head."""

    def run(a: np.ndarray):
        r, q = a.astype(np.float64).copy(), np.eye(len(a))
        for k in range(min(len(a) - 1, a.shape[1])):
            x = r[k:, k].copy()
            size = np.linalg.norm(x)
            if size == 0:
                continue
            x[0] += size if x[0] >= 0 else -size
            x /= np.linalg.norm(x)
            r[k:, k:] -= 2 * np.outer(x, x @ r[k:, k:])
            q[:, k:] -= 2 * np.outer(q[:, k:] @ x, x)
        return 0, {"q": q, "r": np.triu(r)}

    return per_matrix(a, run)


def solve(a: DataFrame, b: DataFrame) -> DataFrame:
    """x of a x = b by LU."""

    def run(a: np.ndarray, b: np.ndarray):
        info, x, rows = eliminate(a)
        if info:
            return info, {}
        y = substitute(x, b[rows], "lower_unit")[1]
        return 0, {"x": substitute(x, y, "upper")[1]}

    return per_matrix(a, run, b)


def solve_spd(a: DataFrame, b: DataFrame) -> DataFrame:
    """x of a x = b by Cholesky."""

    def run(a: np.ndarray, b: np.ndarray):
        info, low = _lower(a)
        if info:
            return info, {}
        return 0, {"x": substitute(low, substitute(low, b, "lower")[1], "lower_transposed")[1]}

    return per_matrix(a, run, b)


def inverse(a: DataFrame) -> DataFrame:
    def run(a: np.ndarray):
        info, x, rows = eliminate(a)
        if info:
            return info, {}
        y = substitute(x, np.eye(len(a))[rows], "lower_unit")[1]
        return 0, {"inverse": substitute(x, y, "upper")[1]}

    return per_matrix(a, run)


def cholesky_solve(low: DataFrame, b: DataFrame) -> DataFrame:
    """x of L L^T x = b from L."""

    def run(low: np.ndarray, b: np.ndarray):
        info, y = substitute(low, b, "lower")
        return (info, {}) if info else (0, {"x": substitute(low, y, "lower_transposed")[1]})

    return per_matrix(low, run, b)


def cholesky_inverse(low: DataFrame) -> DataFrame:
    """The inverse of L L^T from L."""

    def run(low: np.ndarray):
        info, y = substitute(low, np.eye(len(low)), "lower")
        return (info, {}) if info else (0, {"inverse": substitute(low, y, "lower_transposed")[1]})

    return per_matrix(low, run)


def svd(a: DataFrame) -> DataFrame:
    """Factors u, s (one row) and vt."""

    def run(a: np.ndarray):
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        return 0, {"u": u, "s": s, "vt": vt}

    return per_matrix(a, run)


def eigh(a: DataFrame) -> DataFrame:
    """Factors values (one row, ascending) and vectors (columns) of symmetric matrices."""

    def run(a: np.ndarray):
        values, vectors = np.linalg.eigh(a)
        return 0, {"values": values, "vectors": vectors}

    return per_matrix(a, run)
