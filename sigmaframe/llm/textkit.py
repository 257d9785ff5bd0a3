"""Vectorised helpers over Arrow batches of texts: byte buffers, rolling hashes, words and lines.

A batch is handled in slices of bounded text size, so an operator's memory does not depend on how
many rows Spark puts in a batch; one text longer than the bound makes a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
_BYTE_CODES = None
#: Byte ranges up to this length are compared by rolling hashes; longer ones, which could be built to agree in those, by xxh3.
ROLLED = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits of a hash are usable alike."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_codes() -> np.ndarray:
    global _BYTE_CODES
    if _BYTE_CODES is None:
        _BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
    return _BYTE_CODES


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Rolling:
    """Hashes of arbitrary ranges of a uint8 (or uint64-coded) buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        codes = _byte_codes()[data] if data.dtype == np.uint8 else data.astype(U64)
        up, self._down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(codes * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self._down[start]
        return mix(h + (end - start).astype(U64) * U64(0xA24BAED4963EE407))

    def windows(self, width: int) -> np.ndarray:
        """Hash of every range of `width` items."""
        n = len(self.sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[width:] - self.sums[:n]) * self._down[:n])


class Texts:
    """Texts laid end to end: `data` holds their UTF-8 bytes and `offsets` their bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """Nulls become empty texts."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        _, where, what = column.buffers()
        if len(column) == 0:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
        return cls(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def hashes(self, start: np.ndarray, end: np.ndarray, roll: Rolling | None = None) -> np.ndarray:
        """Hashes of byte ranges; no structure of the bytes makes different ranges agree."""
        out = (roll or Rolling(self.data)).of(start, end)
        for k in np.flatnonzero(end - start > ROLLED):
            out[k] = xxhash.xxh3_64_intdigest(self.data[start[k] : end[k]])
        return out

    def slices(self, limit: int) -> Iterator[tuple[int, Texts]]:
        """Consecutive runs of texts of at most `limit` bytes (or one longer text), with the first one's index."""
        n, at = len(self), 0
        while at < n:
            end = int(np.searchsorted(self.offsets, self.offsets[at] + limit, "right")) - 1
            end = min(n, max(end, at + 1))
            low = self.offsets[at]
            yield at, Texts(self.data[low : self.offsets[end]], self.offsets[at : end + 1] - low)
            at = end

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text in which each byte position lies."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of the maximal runs of bytes that are not ASCII white space; none crosses texts."""
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = ~space
        bound = self.offsets[1:-1]
        starts = inside[1:-1] & ~inside[:-2]
        cuts = bound[(bound < len(self.data))]
        if len(cuts):
            starts[cuts] |= inside[1:-1][cuts]
        first = np.flatnonzero(starts)
        ends_flag = inside[1:-1] & ~inside[2:]
        if len(cuts):
            before = cuts[cuts > 0] - 1
            ends_flag[before] |= inside[1:-1][before]
        last = np.flatnonzero(ends_flag) + 1
        return first, last, self.owner(first)


def united(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches in one, until it has `least` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def small_batches(spark) -> None:
    """Keeps batches of text small; sizes are bounded again inside each operator. Also ships the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")


#: Bytes of a source (as stored) that one task should read at least, where what tasks send depends on their number.
TASK_BYTES = 16 << 20


def fewer_tasks(df):
    """df in larger partitions if its source is dealt over many small ones; never in fewer than the cluster has cores."""
    stored_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(-(-stored_bytes // TASK_BYTES), 1_000_000)))


def trim() -> None:
    """Gives freed memory back to the system, so that workers kept for reuse hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it keeps its own rules
        return


class Names(dict):
    """Fresh column names of a DataFrame by the caller's names, so that none clashes with an operator's own."""

    def __init__(self, columns: list[str]):
        self.pairs = [(c, f"in{k}") for k, c in enumerate(columns)]
        super().__init__(self.pairs)

    def restore(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(n).alias(c) for c, n in self.pairs))


def renamed(df: DataFrame) -> tuple[DataFrame, Names]:
    """df with fresh column names, and these."""
    own = Names(df.columns)
    return df.toDF(*(n for _, n in own.pairs)), own


def _filesystem(spark, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors can reach; it goes when Spark ends.

    Only where Spark runs in one process, as in tests, may the setting be missing.
    """
    import atexit
    import shutil
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_llm_shared", None)
        if base is None:
            own = tempfile.mkdtemp(prefix="llm-shared-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = spark._llm_shared = f"file://{own}"
    folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    at, files = _filesystem(spark, folder)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return folder


def discard(spark, folder: str, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables of a shared folder that nothing reads any more."""
    at, files = _filesystem(spark, folder)
    for entry in files.listStatus(at):
        if entry.getPath().getName() not in keep:
            files.delete(entry.getPath(), True)


def stored(df, folder: str, name: str, release: bool = False):
    """Writes df as Parquet in a shared folder and reads it back: cuts lineage and survives lost executors.

    With release, the shuffle files of the plan just run are given up before anything else runs.
    """
    path = f"{folder}/{name}"
    spark = df.sparkSession
    df.write.parquet(path)
    if release:
        # they go once no event waits that refers to the plan and the driver has collected it
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
    return spark.read.schema(df.schema).parquet(path)


class HashArray:
    """A sorted array of distinct 64-bit hashes; positions are found through an index by leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        self.shift = U64(64 - bits)
        count = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.padded = np.append(keys, U64(0xFFFFFFFFFFFFFFFF))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each wanted hash and whether it is there."""
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.padded[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.padded[at[behind]] < wanted[behind]]
        return at, (self.padded[at] == wanted) & (at < len(self.keys))
