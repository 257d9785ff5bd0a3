"""Blocks of texts: a table whose rows hold a few megabytes of whole texts each, compressed.

Operators that compare all texts with each other exchange sorted arrays between blocks and hash
buckets instead of a row for every window; a block is read again by its id when answers come back.
The table is written once in the shared folder, so block ids stay the same for all later stages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Texts, fewer_tasks, small_batches, stored

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
SCHEMA = "block long, ids binary, offsets binary, data binary, rest binary"
LAST = np.iinfo(np.int64).max


def pack(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _serial(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def rest_of(b: bytes) -> pa.RecordBatch:
    """The other columns of a block's rows."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b)).read_next_batch()


def rows_of(batch: pa.RecordBatch):
    """The rows of a batch as dictionaries, one in memory at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def write_blocks(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The block table of docs; a null id counts as larger than all others, a null text as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c) for c in keep))

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def block():
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            texts = Texts.of(table.column(1))
            rest = table.drop_columns(["_id", "_text"])
            others = rest.to_batches()[0] if rest.num_columns else pa.RecordBatch.from_arrays([], [])
            row = [(part << 32) + number, pack(table.column(0).to_numpy().astype("<i8")), pack(texts.offsets.astype("<i8")), pack(texts.data, 9), _serial(others)]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 4))], ["block", "ids", "offsets", "data", "rest"])

        for batch in batches:
            offsets = Texts.of(batch.column(1)).offsets
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(offsets, offsets[at] + block_bytes - size, "right")) - 1
                end = min(batch.num_rows, max(end, at if held else at + 1))
                if end > at:
                    held.append(batch.slice(at, end - at))
                    size += int(offsets[end] - offsets[at])
                    at = end
                if at < batch.num_rows or size >= block_bytes:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return stored(fewer_tasks(rows).mapInArrow(run, SCHEMA), folder, "blocks")


def texts_of(row: dict) -> tuple[np.ndarray, Texts]:
    """Ids and texts of one row of the block table."""
    return unpack(row["ids"], "<i8"), Texts(unpack(row["data"], np.uint8), unpack(row["offsets"], "<i8"))
