"""Packing by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left is sorted
by length; a segment tree over the remaining capacities finds the tightest open window
that takes a piece. Each block of pieces of a task packs by itself, so nothing is
shuffled, memory is bounded, and only each block's last windows stay part empty.

Cases: a null text counts as empty and is one end id; an empty table gives an empty
result; equal lengths keep their order; repeated rows and null doc_ids are packed like
any others; a document of any length is cut as often as needed; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import lean, pick, prepare, tokenizer_path

#: So many pieces are packed together, if no other number is asked for.
BLOCK_PIECES = 50_000


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree of their counts over the capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.at[capacity].append(number)
        i = self.size + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a window of the smallest capacity of at least `need`."""
        i, c = self.size + need, self.count
        if not c[i]:
            while i > 1 and not (i % 2 == 0 and c[i + 1]):  # up, until there is something to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if c[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            c[i] -= 1
            i >>= 1
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece, and how many windows there are. No length is over `window`."""
    place, offset, used = [0] * len(lengths), [0] * len(lengths), 0
    tree = OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = tree.take(n)
        capacity, w = found if found else (window, used)
        used += not found
        place[i], offset[i] = w, window - capacity
        if capacity > n:
            tree.add(capacity - n, w)
    return place, offset, used


def pack(docs: DataFrame, window: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, with_ids: bool = False, width: int = 2, block: int = BLOCK_PIECES) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Each `block` of pieces of a task is packed by itself, so a task's last windows stay part empty.
    Window numbers are the task's number times 2^33 and a count, so they differ between tasks.
    """
    prepare(docs.sparkSession)
    end = int(end_id).to_bytes(width, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        enc = bpe.word_encoder(tokenizer_path(tokenizer), width)
        rows: list[list] = [[] for _ in range(5 + with_ids)]

        def flush():
            nonlocal base, rows
            place, offset, used = best_fit_decreasing(rows[2], window)
            cols = [pa.array(rows[0], pa.int64()), *[pa.array(c, pa.int64()) for c in rows[1:5]], pa.array([base + p for p in place], pa.int64()), pa.array(offset, pa.int64())]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, f"<u{width}").astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
            # rows: doc_id, start, length, crc, doc_tokens
            out = pa.RecordBatch.from_arrays(cols, names=names)
            base += used
            rows = [[] for _ in range(5 + with_ids)]
            return out

        for b in batches:
            for k, x in zip(b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()])):
                x += end
                wide = x if width == 4 else np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()
                total = len(wide) // 4
                for a in range(0, total, window):
                    piece = wide[4 * a : 4 * (a + window)]
                    for c, v in zip(rows, (k, a, len(piece) // 4, zlib.crc32(piece), total)):
                        c.append(v)
                    if with_ids:
                        rows[5].append(x[width * a : width * (a + window)])
                if len(rows[0]) >= block:
                    yield flush()
        if rows[0]:
            yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return pick(docs, "doc_id", "text").mapInArrow(lean(run), schema)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id and its padded ids, from pieces with their ids."""
    from pyspark.sql import functions as F

    whole = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(window) - F.size("ids")))).alias("ids"))
