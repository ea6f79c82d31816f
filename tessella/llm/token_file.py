"""Token-id output: concatenated ids with Elias-Fano coded document boundaries.

A segment is one blob: a head, the documents' ids and their ends in the segment (both
Elias-Fano coded), and the token ids one after another in 2 or 4 bytes each. Segments
hold consecutive documents in ascending doc_id order and are written as rows of a
Parquet table (part, segment number within it, counts, ids before it in the part, blob), so Spark's
committers guard them and any store that Spark writes to will do. A document's offset
comes from select(), without a table of 64-bit offsets.

Cases: a null text counts as empty and has just the end id; null doc_ids come first;
equal doc_ids stand in the order of their texts; an empty table gives an empty file and
result; a document longer than a segment has a segment to itself; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_map, pick, prepare, tokenizer_path

SEGMENT_IDS = 1 << 19
_HEAD = struct.Struct("<8sBQQqQ")
_MAGIC = b"TSLEF001"
_EVERY = 256
#: Of the files: the part and the segment's number in it, its documents and ids, the ids before it in its part, and the segment itself.
SCHEMA = "part int, segment int, n_docs long, n_ids long, before long, blob binary"


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Per byte: how many ones it has, and where its n-th one is.
_ONES = _BITS.sum(1, dtype=np.int64)
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)


class EliasFano:
    """Non-decreasing numbers in [0, universe] in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        bits = np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little")
        #: Of every _EVERY-th one: the byte it stands in, and the ones before that byte; 4 bytes each.
        ones = np.cumsum(bits.reshape(-1, 8).sum(1, dtype=np.int64)) if len(bits) else np.zeros(0, np.int64)
        self.sample = np.searchsorted(ones, np.arange(0, n, _EVERY), "right").astype(np.uint32)
        self.before = np.where(self.sample > 0, ones[np.maximum(self.sample.astype(np.int64), 1) - 1] if len(ones) else 0, 0).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        l = max(0, (top // n).bit_length() - 1) if n and top else 0
        low = b""
        if l:
            bits = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits, bitorder="little").tobytes()
        high = np.zeros(-(-((top >> l) + n + 1) // 8) * 8, np.uint8)
        high[(values >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, l, low, np.packbits(high, bitorder="little").tobytes())

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        part = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8], "little")
        return (part >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte = int(self.sample[i // _EVERY])
        left = i - int(self.before[i // _EVERY])
        while (c := self.high[byte].bit_count()) <= left:
            left, byte = left - c, byte + 1
        b = self.high[byte]
        for _ in range(left):
            b &= b - 1
        at = byte * 8 + ((b & -b).bit_length() - 1)
        return ((at - i) << self.low_bits) | self._low(i)

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places, by the same structure: from each place's sample, byte by byte for all at once, then within the byte."""
        i = np.asarray(i, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("out of range")
        high = np.frombuffer(self.high, np.uint8)
        byte, left = self.sample[i // _EVERY].astype(np.int64), i - self.before[i // _EVERY].astype(np.int64)
        move = np.arange(len(i))
        while len(move):
            c = _ONES[high[byte[move]]]
            on = c <= left[move]
            left[move[on]] -= c[on]
            move = move[on]
            byte[move] += 1
        out = (byte * 8 + _NTH[high[byte], left] - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = (i * self.low_bits)[:, None] + np.arange(self.low_bits)
            low = np.frombuffer(self.low, np.uint8)
            out |= ((low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out

    def all(self) -> np.ndarray:
        """All numbers; the same as select() of each."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n].astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        if not self.low_bits or not self.n:
            return ones
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (ones << np.uint64(self.low_bits)) | low

    def dump(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high

    @classmethod
    def load(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, l, a, b = struct.unpack_from("<QBQQ", raw, at)
        at += 25
        return cls(n, l, raw[at : at + a], raw[at + a : at + a + b]), at + a + b


def pack_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A segment's blob. doc_ids ascend, nulls first; ids: little-endian bytes of `width` an id."""
    nulls = sum(d is None for d in doc_ids)
    known = doc_ids[nulls:]
    least = known[0] if known else 0
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    body = b"".join(ids)
    return _HEAD.pack(_MAGIC, width, len(doc_ids), nulls, least, len(body) // width) + EliasFano.of(np.array([d - least for d in known], np.uint64)).dump() + EliasFano.of(ends).dump() + body


class Segment:
    """Reads a blob; documents by their number in it."""

    def __init__(self, raw: bytes):
        magic, self.width, self.n_docs, self.nulls, self.least, self.n_ids = _HEAD.unpack_from(raw, 0)
        if magic != _MAGIC:
            raise ValueError("not a token segment")
        self.keys, at = EliasFano.load(raw, _HEAD.size)
        self.ends, self.body = EliasFano.load(raw, at)
        self.raw = raw

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [int(x) + self.least for x in self.keys.all()]

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return np.frombuffer(self.raw, f"<u{self.width}", b - a, self.body + a * self.width)


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, width: int = 2) -> None:
    """Tokenizes documents in ascending doc_id order and writes their segments to `path`.

    Rows are ranged by doc_id before they are tokenized, so the sampling pass reads no more than the scan.
    """
    spark = prepare(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Texts' beginnings part the rows of one id, or of none, so these don't make one task.
    rows = pick(docs, "doc_id", "text").repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    end = int(end_id).to_bytes(width, "little")

    def run(batches):
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        enc = bpe.word_encoder(tokenizer_path(tokenizer), width)
        keys: list = []
        ids: list[bytes] = []
        size = 0

        def segment():
            nonlocal keys, ids, size, number, before
            blob = pack_segment(keys, ids, width)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64()), pa.array([before], pa.int64()), pa.array([blob], pa.binary())], names=["part", "segment", "n_docs", "n_ids", "before", "blob"])
            keys, ids, size, number, before = [], [], 0, number + 1, before + size
            return out

        for b in batches:
            for k, x in zip(b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()])):
                x += end
                if keys and size + len(x) // width > SEGMENT_IDS:
                    yield segment()
                keys.append(k)
                ids.append(x)
                size += len(x) // width
        if keys:
            yield segment()

    rows.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    Only the parts' totals come to the driver: a number per written part. Boundaries are read by select.
    """
    prepare(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    starts: dict[int, int] = {}
    total = 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        starts[r.part] = total
        total += r.n

    def run(b: pa.RecordBatch):
        for part, before, raw in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("blob").to_pylist()):
            s = Segment(raw)
            first = starts[part] + before
            ends = s.ends.select_many(np.arange(s.n_docs)).astype(np.int64)
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            view = memoryview(raw)
            crc, ids = [], []
            for a, e in zip(begins.tolist(), ends.tolist()):
                x = np.frombuffer(view, f"<u{s.width}", e - a, s.body + a * s.width)
                crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                if with_ids:
                    ids.append(x.astype(np.int32))
            cols = [pa.array(s.doc_ids(), pa.int64()), pa.array(begins + first, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(files.select("part", "before", "blob"), run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
