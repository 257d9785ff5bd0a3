"""Replays a stored table as a stream of blocks, and returns what a streaming query makes of it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of each series in one block.
BLOCK = 32


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where Spark runs in one process may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="streams-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replayed(df: DataFrame, key: str, position: str, query: Callable[[DataFrame], DataFrame], blocks: int = 3) -> DataFrame:
    """The rows that query makes of df's rows, read as a stream: `blocks` - 1 blocks of BLOCK positions a series, then the rest."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    block = F.least(F.floor(F.col(position) / BLOCK), F.lit(blocks - 1))
    df.write.parquet(f"{folder}/all")
    rows = spark.read.schema(df.schema).parquet(f"{folder}/all")
    for k in range(blocks):  # the file source takes files in the order in which they were written
        rows.where(block == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    done = query(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
