"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of binary length (the set bits of n, the longest first,
none above the sequence length), and every piece is a sequence of its own in the bucket of its
length. No sequence holds two documents and none needs padding; batches are drawn from one bucket.

Nulls and empty texts have the closing token alone, so one piece of length 1. Repeated rows are
packed each on its own. Sequence ids are unique; they are fixed for a fixed input layout.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import GATHERED, encoder, odd_characters
from .textkit import small_batches, united

SEQUENCE = 4096


def binary_lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """The piece lengths of a document of n tokens; `longest` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", longest: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """One row per piece: its place in the document and its sequence, and with_ids its token ids."""
    small_batches(docs.sparkSession)
    closing, odd = np.array([end_id], "<u4").tobytes(), odd_characters(path)

    def run(batches):
        enc = encoder(path, odd)
        for batch in united(batches, GATHERED):
            coded_all = enc.encode_all(batch.column(1).to_pylist())
            for low in range(0, batch.num_rows, 250):
                part = batch.slice(low, 250)
                owner, start, length, crc, total, ids = [], [], [], [], [], []
                for k, coded in enumerate(coded_all[low : low + 250]):
                    coded += closing
                    at = 0
                    for size in binary_lengths(len(coded) // 4, longest):
                        own = coded[4 * at : 4 * (at + size)]
                        owner.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own))
                        total.append(len(coded) // 4)
                        ids.append(own)
                        at += size
                columns = [part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), flat))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])
        enc.rest()

    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    return cut.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Stores sequences by bucket, one directory for each length, so that a batch reads equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
