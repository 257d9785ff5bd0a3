"""Ambiguity map, detection and the strongest peaks in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.radar import ca_cfar_2d, caf, caf_maps, map_peaks

BINS, START, STEP, RATE, RANGES = 5, -20.0, 10.0, 1000.0, 9
GUARD, REFERENCE, FACTOR = (0, 1), (1, 2), 1.5


def echoes(signals: DataFrame, delay: int = 3) -> tuple[DataFrame, DataFrame]:
    """Each series as reference and, as surveillance, the series delayed by some samples and zeros before."""
    later = signals.select("series", (F.col("i") + delay).alias("i"), "re", "im")
    early = signals.where(F.col("i") < delay).select("series", "i", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    return signals, later.unionByName(early)


def ambiguity(signals: DataFrame, strategy: str = "auto") -> DataFrame:
    return caf(*echoes(signals), ["series"], BINS, START, STEP, RATE, RANGES, strategy)


def peaks(signals: DataFrame, top: int = 3, strategy: str = "auto") -> DataFrame:
    """The strongest detections of each series' ambiguity map; a map is one row, so detection and ranking need no shuffle."""
    if strategy != "relational":
        maps = caf_maps(*echoes(signals), ["series"], BINS, START, STEP, RATE, RANGES)
        return map_peaks(maps, ["series"], RANGES, GUARD, REFERENCE, FACTOR, top)
    found = ca_cfar_2d(ambiguity(signals, strategy), GUARD, REFERENCE, FACTOR, ["series"]).where("det = 1")
    order = Window.partitionBy("series").orderBy(F.round("v", 6).desc(), "d", "r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("series", "rank", "d", "r", "v")
