"""Matrix algebra on coordinate rows (m, i, j, v), or (m, i, j, re, im) for products; m names the matrix of a batch.

Products are joins of square tiles on the inner index: a row of the join is a product of two tiles,
done by NumPy, and the tiles of one place are summed with a map-side combine. So a batch of any number
of matrices, or one matrix of any size, is dealt over the cluster by tile. Cells without a row are
zeros. Shapes that do not match give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def tile_size(cache_bytes: int = 2 << 20, cell_bytes: int = 8) -> int:
    """Blocking parameter: the side of tiles of which three (two factors and their product) fit a cache, in steps of 8."""
    return max(8, int(math.sqrt(cache_bytes / (3 * cell_bytes))) // 8 * 8)


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.select("m", F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("v").alias("av")), b.select(F.col("m").alias("bm"), F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("v").alias("bv"))


def _matching(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrices whose inner sizes agree."""
    wide = a.groupBy("m").agg(F.max("j").alias("inner"))
    tall = b.groupBy(F.col("m").alias("bm")).agg(F.max("i").alias("binner"))
    return wide.join(tall, (F.col("m") == F.col("bm")) & (F.col("inner") == F.col("binner"))).select("m")


def _values(a: DataFrame) -> list[str]:
    return ["re", "im"] if "re" in a.columns else ["v"]


def _tiles(a: DataFrame, tile: int, kind: str) -> DataFrame:
    """One row a tile: m, its place (x, y) and its cells."""
    cell = F.struct((F.col("i") % tile).cast("int").alias("i"), (F.col("j") % tile).cast("int").alias("j"), *(F.col(c).cast(kind).alias(c) for c in _values(a)))
    return a.groupBy("m", F.floor(F.col("i") / tile).cast("int").alias("x"), F.floor(F.col("j") / tile).cast("int").alias("y")).agg(F.collect_list(cell).alias("cells"))


def _dense(cells: pa.ListScalar, rows: int | None = None) -> np.ndarray:
    fields = [cells.values.field(k).to_numpy(zero_copy_only=False) for k in range(cells.values.type.num_fields)]
    i, j, v = fields[0], fields[1], fields[2] if len(fields) == 3 else fields[2] + 1j * fields[3]
    out = np.zeros((int(i.max()) + 1, int(j.max()) + 1), v.dtype)
    out[i, j] = v
    return out


def gemm(a: DataFrame, b: DataFrame, value: str = "double", checked: bool = True, tile: int | None = None, conjugate: bool = False) -> DataFrame:
    """a times b (or its conjugate); value is the type that products are summed in, complex matrices have columns re and im."""
    if checked:
        fits = _matching(a, b)
        a = a.join(fits, "m", "left_semi")
    ship(a.sparkSession)
    names = _values(a)
    tile = tile or tile_size(cell_bytes=8 * len(names))
    left = _tiles(a, tile, value)
    right = _tiles(b, tile, value).select(F.col("m").alias("bm"), F.col("x").alias("bx"), F.col("y").alias("z"), F.col("cells").alias("others"))
    pairs = left.join(right, (F.col("m") == F.col("bm")) & (F.col("y") == F.col("bx"))).select("m", "x", "z", "cells", "others")
    key = a.schema["m"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                p, q = _dense(batch.column(3)[k]), _dense(batch.column(4)[k])
                inner = min(p.shape[1], q.shape[0])  # cells beyond are zeros
                c = p[:, :inner] @ (np.conj(q[:inner]) if conjugate else q[:inner])
                i, j = np.indices(c.shape, np.int64)
                parts = [c.real, c.imag] if len(names) == 2 else [c]
                m = batch.column(0).slice(k, 1).take(pa.array(np.zeros(c.size, np.int64)))
                places = [i.ravel() + batch.column(1)[k].as_py() * tile, j.ravel() + batch.column(2)[k].as_py() * tile]
                yield pa.RecordBatch.from_arrays([m, *map(pa.array, places), *(pa.array(np.ascontiguousarray(v).ravel()) for v in parts)], ["m", "i", "j", *names])

    products = pairs.mapInArrow(run, f"m {key}, i long, j long, " + ", ".join(f"{c} {value}" for c in names))
    return products.groupBy("m", "i", "j").agg(*(F.sum(c).alias(c) for c in names))


def gemm_cells(a: DataFrame, b: DataFrame, value: str = "double", checked: bool = True) -> DataFrame:
    """gemm() as a join of single cells, for matrices with few of them: only products of cells that exist are done and returned."""
    if checked:
        fits = _matching(a, b)
        a = a.join(fits, "m", "left_semi")
    x, y = _sides(a, b)
    product = F.col("av").cast(value) * F.col("bv").cast(value)
    return x.join(y, (F.col("m") == F.col("bm")) & (F.col("aj") == F.col("bi"))).groupBy("m", F.col("ai").alias("i"), F.col("bj").alias("j")).agg(F.sum(product).alias("v"))


def gemm_accumulate(c: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """c plus a times b."""
    both = c.select("m", "i", "j", "v").unionByName(gemm(a, b))
    return both.groupBy("m", "i", "j").agg(F.sum("v").alias("v"))


def gram(a: DataFrame) -> DataFrame:
    """a times its transpose."""
    return gemm(a, transpose(a), checked=False)


def gemv(a: DataFrame, x: DataFrame) -> DataFrame:
    """a times the vectors x (m, i, v)."""
    y = gemm(a, x.select("m", "i", F.lit(0).alias("j"), "v"))
    return y.select("m", "i", "v")


def transpose(a: DataFrame) -> DataFrame:
    return a.select("m", F.col("j").alias("i"), F.col("i").alias("j"), *_values(a))


def scale(a: DataFrame, s: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * F.lit(float(s)))


def add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    """a plus sign times b; a sum by cell, so absent cells are zeros."""
    other = b.select("m", "i", "j", (F.col("v") * sign).alias("v"))
    return a.select("m", "i", "j", "v").unionByName(other).groupBy("m", "i", "j").agg(F.sum("v").alias("v"))


def sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1.0)


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["m", "i", "j"]).select("m", "i", "j", (F.col("v") * F.col("w")).alias("v"))


def outer(u: DataFrame, v: DataFrame) -> DataFrame:
    """Of vectors (m, i, v): the matrix of all products, by an equi-join on the matrix."""
    right = v.select("m", F.col("i").alias("j"), F.col("v").alias("w"))
    return u.join(right, "m").select("m", "i", "j", (F.col("v") * F.col("w")).alias("v"))


def gemm_int8(a: DataFrame, b: DataFrame) -> DataFrame:
    """Exact product of 8-bit integers, summed in 64 bits and returned as 32-bit integers."""
    return gemm(a, b, "bigint").withColumn("v", F.col("v").cast("int"))


def gemm_affine(a: DataFrame, b: DataFrame, a_scale: float, a_zero: int, b_scale: float, b_zero: int) -> DataFrame:
    """Product of affinely quantised matrices: the integer sum of (a - a_zero)(b - b_zero), then scaled."""
    shifted = [x.withColumn("v", F.col("v").cast("bigint") - z) for x, z in ((a, a_zero), (b, b_zero))]
    return gemm(*shifted, "bigint").withColumn("v", F.col("v").cast("double") * (a_scale * b_scale))


def identity(like: DataFrame) -> DataFrame:
    """The identity of each matrix's size."""
    sizes = like.groupBy("m").agg(F.max("i").alias("n"))
    return sizes.select("m", F.explode(F.sequence(F.lit(0), "n")).alias("i")).select("m", "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
