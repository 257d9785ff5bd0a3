"""Conversions between NumPy and the long forms."""

import numpy as np


def signal(spark, series, name="v"):
    rows = [(s, i, float(v)) for s, x in enumerate(series) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"series int, i int, {name} double")


def csignal(spark, series):
    rows = [(s, i, float(z.real), float(z.imag)) for s, x in enumerate(series) for i, z in enumerate(x)]
    return spark.createDataFrame(rows, "series int, i int, re double, im double")


def matrix(spark, *matrices, kind="double"):
    cast = float if kind == "double" else int
    rows = [(m, i, j, cast(v)) for m, a in enumerate(matrices) for (i, j), v in np.ndenumerate(np.asarray(a))]
    return spark.createDataFrame(rows, f"m long, i int, j int, v {kind}")


def grid(spark, *grids):
    rows = [(g, d, r, float(v)) for g, a in enumerate(grids) for (d, r), v in np.ndenumerate(np.asarray(a))]
    return spark.createDataFrame(rows, "g int, d int, r int, v double")


def arrays(df, key="series", position="i", *values):
    out = {}
    for row in df.orderBy(key, position).collect():
        out.setdefault(row[key], []).append([row[v] for v in values or ("v",)])
    return {k: np.squeeze(np.array(v), axis=1) if len(values) < 2 else np.array(v) for k, v in out.items()}


def cells(df, m=0, i="i", j="j", key="m"):
    rows = df.where(f"{key} = {m}").collect()
    if not rows:
        return np.zeros((0, 0))
    out = np.zeros((max(r[i] for r in rows) + 1, max(r[j] for r in rows) + 1))
    for r in rows:
        out[r[i], r[j]] = r["v"]
    return out
