"""Packing of documents into fixed sequences along a Hilbert curve.

Every document becomes a hashed vector of its token counts, projected to four
dimensions; its key is the place of that point on a Hilbert curve. Documents are
ordered by range sort on (key, doc_id, hash of the text), and the ordered stream of ids is cut every
`length` ids, so neighbours on the curve share sequences and only the last
sequence of all can be short.

Defined cases: a null or empty text is the end id alone; rows that repeat a
doc_id are packed one by one; a null doc_id is carried through; ties on the key
follow doc_id, then the text, so that the order of the files has no part in the
result; a text of any length is cut into as many pieces as it needs; an empty
table gives no piece; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm._io import Scratch, small_batches
from cadastra.llm.wordbpe import WordEncoder, binary_column, public_path, shared_encoder

DIMENSIONS, BITS, FEATURES = 4, 10, 256


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows; each coordinate of so many bits) on a Hilbert curve."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap if i else np.uint64(0)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.view(np.int64)


def curve_keys(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents from their ids."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    feature = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
    count = np.bincount(doc * FEATURES + feature, minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float64)
    count /= np.maximum(np.linalg.norm(count, axis=1, keepdims=True), 1e-9)
    point = count @ np.random.default_rng(7).standard_normal((FEATURES, DIMENSIONS))
    top = (1 << BITS) - 1
    return hilbert(np.clip(np.round((point + 3) / 6 * top), 0, top).astype(np.int64), BITS)


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = shared_encoder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, ids, off in encoder.encode(batch.column(1), end):
                cols = [pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(curve_keys(ids, off)), pa.array(np.diff(off).astype(np.int64)), binary_column(ids, off)]
                row += b - a
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "mark", "place", "n", "ids"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition and the ids before each row in it."""
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False)
        ahead = start + np.cumsum(n) - n
        start += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), part, np.int64)), pa.array(ahead.astype(np.int64))], names=["row", "n", "part", "ahead"])


def _cut(length: int, dtype: type, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, blob, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = np.frombuffer(blob.as_buffer(), dtype).astype("<u4")
                a = 0
                while a < len(ids):
                    b = min(len(ids), a + length - (at + a) % length)
                    piece = ids[a:b].tobytes()
                    for column, value in zip(out, (doc, a, b - a, zlib.crc32(piece), len(ids), (at + a) // length, (at + a) % length, piece)):
                        column.append(value)
                    a = b
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            cols = [pa.array(c, pa.int64()) for c in out[:7]]
            if with_ids:
                names, cols = [*names, "ids"], [*cols, pa.array(out[7], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Ids are written once; only (row, key, count) is range-sorted, and each
    document's place in the stream is joined back to its ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "packing")
    path = tokenizer or public_path()
    dtype = WordEncoder(path, 1).dtype
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    coded = tmp.save(source.mapInArrow(_encode(path, end_id), "row long, doc_id long, mark long, place long, n long, ids binary"), "coded")
    ties = ["place", "doc_id", "mark", "row"]  # rows that differ in the last alone are equal
    slim = coded.select("row", "n", "place", "doc_id", "mark").repartitionByRange(*ties).sortWithinPartitions(*ties)
    order = tmp.save(slim.select("row", "n").mapInArrow(_running, "row long, n long, part long, ahead long"), "order")
    parts = order.groupBy("part").agg(F.sum("n").alias("size"))
    base = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))  # a row for each partition
    placed = order.join(base, "part").select("row", (F.col("base") + F.col("ahead")).alias("at"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    # A merge join at any size: the smaller side grows with the rows, so it is not broadcast.
    return coded.select("row", "doc_id", "ids").join(placed.hint("merge"), "row").select("doc_id", "ids", "at").mapInArrow(_cut(length, dtype, with_ids), schema)
