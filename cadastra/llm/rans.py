"""Token-ID files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids, is shared by every block. A block
holds whole documents; its ids are dealt over interleaved lanes, each a 64-bit
rANS state that spills 32-bit words into one common stream. Checkpoints keep all
lane states and the place in the stream, so each segment of a block can be
decoded by itself, and a checksum of the ids guards every segment.

File format, a folder of Parquet tables (any Hadoop store holds it, and a lost
task leaves no partial file): `table` (id, freq), frequencies sum to 2 ** SCALE;
`blocks` (part, first, doc_ids, lengths, payload). A payload is, little-endian:
magic "RNS1", segments, lanes, ids, words (4 unsigned 32-bit integers); for each
segment: first step, first word, crc32 (unsigned 32-bit), then lane states
(unsigned 64-bit); then the words (unsigned 32-bit).

Defined cases: a null or empty text is the end id alone; rows that repeat a
doc_id keep separate places, in order of their text; a null doc_id comes first;
an empty table gives files without rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.llm._io import Scratch, small_batches
from cadastra.llm.wordbpe import WordEncoder, binary_column, public_path, shared_encoder

SCALE, LANES, SEGMENT_STEPS, BLOCK_IDS = 20, 4096, 128, 1 << 20
_LOW = np.uint64(1 << 31)
_U = np.uint64


def scaled(ids: np.ndarray, counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2 ** scale, in proportion to counts."""
    total = 1 << scale
    free = total - len(ids)
    freq = 1 + (counts.astype(np.float64) / counts.sum() * free).astype(np.int64)
    rest = total - int(freq.sum())
    order = np.lexsort((ids, -counts))
    freq[order[: rest % len(ids)]] += 1
    return freq + rest // len(ids)


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, scale: int = SCALE):
        size = int(ids.max()) + 1 if len(ids) else 1
        self.scale = scale
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[ids] = freq
        self.start[ids] = np.cumsum(freq) - freq
        self.symbol = np.repeat(ids, freq).astype(np.uint32)

    def encode(self, ids: np.ndarray, lanes: int = LANES, segment: int = SEGMENT_STEPS) -> bytes:
        """The payload of ids."""
        n = len(ids)
        lanes = min(lanes, 1 << max(0, (n // 64).bit_length() - 1) if n >= 64 else 1)
        steps = -(-n // lanes)
        x = np.full(lanes, _LOW, np.uint64)
        up, shift = _U(63 - self.scale), _U(self.scale)
        f_all, c_all = self.freq[ids], self.start[ids]
        words, marks = [], []
        for t in range(steps - 1, -1, -1):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            f, c, y = f_all[a:b], c_all[a:b], x[: b - a]
            full = y >= (f << up)
            words.append(y[full].astype(np.uint32))
            y = np.where(full, y >> _U(32), y)
            q = y // f
            x[: b - a] = (q << shift) + (y - q * f) + c
            if t % segment == 0:
                marks.append((t, len(words), x.copy()))
        ahead = np.cumsum([0, *(len(w) for w in reversed(words))])
        parts = [struct.pack("<4s4I", b"RNS1", len(marks), lanes, n, int(ahead[-1]))]
        for t, done, states in reversed(marks):
            own = ids[t * lanes : (t + segment) * lanes].astype("<u4").tobytes()
            parts += [struct.pack("<3I", t, int(ahead[len(words) - done]), zlib.crc32(own)), states.astype("<u8").tobytes()]
        parts += [w.astype("<u4").tobytes() for w in reversed(words)]
        return b"".join(parts)

    def decode(self, payload: bytes, only: int | None = None) -> np.ndarray:
        """All ids of a payload, or those of one segment; raises ValueError on damage."""
        magic, segments, lanes, n, count = struct.unpack_from("<4s4I", payload)
        if magic != b"RNS1":
            raise ValueError("not a block of this format")
        head = 12 + 8 * lanes
        words = np.frombuffer(payload, "<u4", count, 20 + segments * head).astype(np.uint64)
        begins = [struct.unpack_from("<3I", payload, 20 + k * head) for k in range(segments)]
        mask, shift, out = _U((1 << self.scale) - 1), _U(self.scale), []
        for k in range(segments) if only is None else [only]:
            t, at, crc = begins[k]
            x = np.frombuffer(payload, "<u8", lanes, 32 + k * head).astype(np.uint64)
            stop = begins[k + 1][0] if k + 1 < segments else -(-n // lanes)
            got = np.empty(min(n, stop * lanes) - t * lanes, np.uint32)
            for step in range(t, stop):
                m = min(n - step * lanes, lanes)
                y = x[:m]
                slot = y & mask
                s = self.symbol[slot.astype(np.int64)]
                y = self.freq[s] * (y >> shift) + slot - self.start[s]
                low = np.flatnonzero(y < _LOW)
                y[low] = (y[low] << _U(32)) | words[at : at + len(low)]
                at += len(low)
                x[:m] = y
                got[(step - t) * lanes : (step - t) * lanes + m] = s
            if zlib.crc32(got.astype("<u4").tobytes()) != crc:
                raise ValueError(f"segment {k}: wrong checksum")
            out.append(got)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _tokens(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ahead = shared_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, ids, off in encoder.encode(batch.column(1), end):
                n = np.diff(off).astype(np.int64)
                cols = [pa.array(np.full(b - a, part, np.int64)), batch.column(0).slice(a, b - a), pa.array(ahead + off[:-1].astype(np.int64)), pa.array(n), binary_column(ids, off)]
                ahead += int(n.sum())
                yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "first", "n", "ids"])

    return run


def _count(dtype: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(np.iinfo(dtype).max + 1 if dtype is np.uint16 else 1 << 22, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), dtype), minlength=len(total))[: len(total)] if len(blob.as_buffer()) > 1 << 16 else 0
            short = b"".join(v for v in batch.column(0).to_pylist() if len(v) <= 1 << 16)
            total += np.bincount(np.frombuffer(short, dtype), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def _blocks(ids: np.ndarray, freq: np.ndarray, dtype: type, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ids, freq)
        held: list = []

        def close() -> pa.RecordBatch:
            part, first = held[0][0], held[0][2]
            payload = coder.encode(np.concatenate([np.frombuffer(h[4], dtype) for h in held]))
            cols = [[part], [first], [[h[1] for h in held]], [[h[3] for h in held]], [payload]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "first", "doc_ids", "lengths", "payload"])

        n = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[0][0] or n + row[3] > size or row[2] != held[-1][2] + held[-1][3]):
                    yield close()
                    n = 0
                held.append(row)
                n += row[3]
        if held:
            yield close()

    return run


def _read(ids: np.ndarray, freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ids, freq)
        for batch in batches:
            for k, (part, first, docs, lengths) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                flat = coder.decode(memoryview(batch.column(4)[k].as_buffer())).astype("<u4", copy=False)
                at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
                cols = [pa.array([part] * len(docs)), pa.array(docs, pa.int64()), pa.array(first + at[:-1]), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "first", "n_tokens", "ids_crc32"])

    return run


def _table(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The frequency table of a file: at most one row for each id of the vocabulary."""
    rows = spark.read.parquet(f"{path}/table").orderBy("id").collect()
    return np.array([r.id for r in rows], np.int64), np.array([r.freq for r in rows], np.int64)


def write_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the ids, in ascending doc_id order, in the format above at path."""
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "rans")
    vocabulary = tokenizer or public_path()
    dtype = WordEncoder(vocabulary, 1).dtype
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = source.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    coded = tmp.save(order.mapInArrow(_tokens(vocabulary, end_id), "part long, doc_id long, first long, n long, ids binary"), "coded")
    counts = coded.select("ids").mapInArrow(_count(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    ids, n = np.array([r.id for r in counts], np.int64), np.array([r.n for r in counts], np.int64)
    freq = scaled(ids, n) if len(ids) else ids
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freq)], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    blocks = coded.select("part", "doc_id", "first", "n", "ids").mapInArrow(_blocks(ids, freq, dtype, block_ids), "part long, first long, doc_ids array<long>, lengths array<long>, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    tmp.drop("coded")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a file: doc_id, start, n_tokens, ids_crc32."""
    small_batches(spark)
    ids, freq = _table(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each partition
    rows = blocks.mapInArrow(_read(ids, freq), "part long, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
