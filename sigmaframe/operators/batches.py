"""Arrow helpers: NumPy on whole series or matrices, a bounded batch of them at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import to_arrays, to_rows
from ..shipping import ship


def map_arrays(arrays: DataFrame, keys: Sequence[str], values: Sequence[str], run: Callable[..., list[list[np.ndarray]]], out: Sequence[str]) -> DataFrame:
    """Applies run to the array columns of many series at once; it returns, for each output, one array a series."""
    ship(arrays.sparkSession)
    n, names = len(keys), list(out)

    def batches(stream):
        for batch in stream:
            inputs = [[np.asarray(x.values if x.is_valid else [], dtype=np.float64) for x in batch.column(n + k)] for k in range(len(values))]
            results = run(*inputs)
            columns = list(batch.columns[:n]) + [pa.array([np.asarray(x, np.float64) for x in r], pa.list_(pa.float64())) for r in results]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:n], *names])

    kinds = {f.name: f.dataType.simpleString() for f in arrays.schema.fields}
    return arrays.select(*keys, *values).mapInArrow(batches, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{c}` array<double>" for c in names)]))


def per_series(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str], run: Callable[..., list[list[np.ndarray]]], out: Sequence[str]) -> DataFrame:
    """Applies run to the arrays of many series at once; it returns, for each output, one array a series.

    A series is one row of arrays; series are dealt over tasks by the grouping's shuffle.
    """
    return to_rows(map_arrays(to_arrays(df, keys, position, values), keys, values, run, out), keys, position, out)


def padded(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unequal length in one matrix, and their lengths."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    out = np.zeros((len(arrays), int(sizes.max(initial=0))))
    for k, a in enumerate(arrays):
        out[k, : len(a)] = a
    return out, sizes


def unpadded(x: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return [x[k, :n] for k, n in enumerate(sizes)]


FACTORS = "m long, info int, factor string, i int, j int, v double"


def per_matrix(a: DataFrame, run: Callable[..., tuple[int, dict[str, np.ndarray]]], b: DataFrame | None = None) -> DataFrame:
    """Applies run to each matrix (and its partner in b): it returns an info code and named factors.

    Rows (m, info, factor, i, j, v); a matrix whose info is not 0 has one row without factor and value.
    """
    ship(a.sparkSession)
    cells = lambda d, name: d.groupBy("m").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))).alias(name))
    packed = cells(a, "a") if b is None else cells(a, "a").join(cells(b, "b"), "m")

    def dense(column: pa.StructScalar) -> np.ndarray:
        rows = column.values
        i, j, v = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        out = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
        out[i, j] = v
        return out

    def batches(stream):
        for batch in stream:
            for k in range(batch.num_rows):
                info, factors = run(*(dense(batch.column(c)[k]) for c in range(1, batch.num_columns)))
                parts = []
                for name, x in factors.items() if info == 0 else ():
                    x = np.atleast_2d(np.asarray(x, np.float64))
                    i, j = np.indices(x.shape, np.int32)
                    parts.append((np.full(x.size, name), i.ravel(), j.ravel(), x.ravel()))
                m = batch.column(0)[k].as_py()
                if not parts:
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([info], pa.int32()), pa.array([None], pa.string()), pa.array([None], pa.int32()), pa.array([None], pa.int32()), pa.array([None], pa.float64())], ["m", "info", "factor", "i", "j", "v"])
                    continue
                name, i, j, v = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), m, np.int64)), pa.array(np.full(len(v), info, np.int32)), pa.array(name.tolist(), pa.string()), pa.array(i), pa.array(j), pa.array(v)], ["m", "info", "factor", "i", "j", "v"])

    return packed.withColumn("m", F.col("m").cast("long")).mapInArrow(batches, FACTORS)


def factor(result: DataFrame, name: str) -> DataFrame:
    """One factor of per_matrix as a matrix."""
    return result.where(F.col("factor") == name).select("m", "i", "j", "v")
