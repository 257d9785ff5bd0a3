"""Connected components of an edge table, as iterated joins, or on the driver if there are few edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import stored

#: Up to so many edges come to the driver; a round of joins costs more than they do.
FEW_EDGES = 20_000


def _joined(edges: list) -> dict:
    """The smallest node that each node is connected with."""
    above: dict = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in edges:
        u, v = top(a), top(b)
        if u != v:
            above[max(u, v)] = min(u, v)
    return {x: top(x) for x in list(above)}


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): for each node of edges (a, b), the smallest node that it is connected with.

    Every round takes the smallest label among a node's neighbours and then the label of that label,
    so long chains shorten by half; rounds end when no label changes. At most FEW_EDGES edges are
    joined on the driver instead, to the same labels.
    """
    few = edges.select("a", "b").limit(FEW_EDGES + 1).collect()
    if few and len(few) <= FEW_EDGES:
        label = _joined(few)
        kind = pa.string() if isinstance(few[0][0], str) else pa.int64()
        table = pa.table({"node": pa.array(list(label), kind), "label": pa.array(list(label.values()), kind)})
        return stored(edges.sparkSession.createDataFrame(table).coalesce(1), folder, "labels")
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), folder, "labels0")
    turn = 0
    while True:
        turn += 1
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to")).agg(F.min("label").alias("least"))
        nearer = stored(labels.join(heard, F.col("node") == F.col("to")).select("node", F.least("label", "least").alias("label"), F.col("label").alias("old")), folder, f"near{turn}")
        jump = nearer.select(F.col("node").alias("of"), F.col("label").alias("further"))
        jumped = nearer.join(jump, F.col("label") == F.col("of"), "left").select("node", F.coalesce("further", "label").alias("label"), (F.coalesce("further", "label") != F.col("old")).alias("moved"))
        jumped = stored(jumped, folder, f"labels{turn}")
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels
