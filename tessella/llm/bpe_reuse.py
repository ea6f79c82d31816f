"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the last bytes cuts texts into chunks of some hundred bytes, so equal
passages of different documents have equal chunks. Each chunk is encoded once per worker
(kept within a bound of bytes) and reused wherever it stands. A cut may lie anywhere,
within a word too, so the ids around it may be wrong; each join is repaired: the text
around it is encoded anew, from one word before the torn one to one word after it, and
where the new ids of the words on both sides agree with the chunks' ids, the new ids of
what lies between take the place of the old ones. Where they don't agree, the window
widens word by word until they do, or until it reaches the ends of the text. Windows that
meet are one. Short chunks and windows without special tokens are encoded from the
vocabulary's ranks (bpe.ranked), which are proven to give the library's ids, all others by
the library. Words end at safe places: before white space that follows a printable ASCII
character, where the vocabulary's pre-tokens part in any context.

Cases: a null text counts as empty: no ids, hashes of the empty string; an empty table
gives an empty result; repeated rows give one row each; a null doc_id passes through;
strings of special tokens are matched as the library matches them; a text without a safe
place is encoded whole if it has joins; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import arrow_map, kept_in_worker, pick, prepare, tokenizer_path

#: Bytes that the rolling hash covers (a power of two), the share of places that it cuts at, and the bytes of chunks and windows that a worker keeps.
SPAN, MARKS, KEEP_BYTES = 16, 1 / 512, 48 << 20
#: Longer parts go to the library, since the pattern of the encoder from ranks takes long for long runs of white space.
RANKED_BYTES = 4096
_GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BEFORE = np.zeros(256, bool)
_BEFORE[33:127] = True


def cut_places(raw: bytes, span: int = SPAN, marks: float = MARKS) -> np.ndarray:
    """Where chunks begin, from the rolling hash of the bytes before; never within a character."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= span:
        return np.zeros(0, np.int64)
    h, width = _GEAR[b], 1
    while width < span:  # h covers `width` bytes that end here
        h = h[width:] + h[:-width] * np.uint32((0x9E3779B1 ** width) & 0xFFFFFFFF)
        width *= 2
    at = np.flatnonzero(h[:-1] * np.uint32(0x85EBCA6B) < np.uint32(marks * (1 << 32))) + span
    return at[(b[at] & 0xC0) != 0x80]


def safe_places(raw: bytes) -> np.ndarray:
    """Places where pre-tokens part in any context, with both ends of the text."""
    b = np.frombuffer(raw, np.uint8)
    inner = np.flatnonzero(_SPACE[b[1:]] & _BEFORE[b[:-1]]) + 1
    return np.concatenate([[0], inner, [len(raw)]])


class Kept:
    """Encodings by text: two generations, each of at most half of the bytes."""

    def __init__(self, most: int):
        self.new, self.old, self.size, self.half = {}, {}, 0, most // 2

    def get(self, part: bytes):
        got = self.new.get(part)
        if got is None and (got := self.old.get(part)) is not None:
            self.put(part, got)
        return got

    def put(self, part: bytes, value: bytes) -> None:
        if self.size > self.half:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[part] = value
        self.size += len(part) + len(value) + 200


class ChunkCoder:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, span: int = SPAN, marks: float = MARKS):
        self.tok, self.kept, self.span, self.marks = bpe.load(path), Kept(KEEP_BYTES), span, marks
        self.ranked = bpe.ranked(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        bytes_of = bpe.byte_alphabet()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.piece = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.piece[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        self.size = np.array([len(p) for p in self.piece])
        self.decimal = [b"%d" % i for i in range(len(self.piece))]
        self.kind = "<u2" if len(self.piece) <= 1 << 16 else "<u4"
        #: Joins repaired, windows that had to widen, parts reused and parts encoded.
        self.repaired = self.widened = self.reused = self.learned = 0

    def _fresh(self, parts: list[bytes]) -> list[bytes]:
        if self.ranked is None:
            return self._by_library(parts)
        plain = [len(p) <= RANKED_BYTES and not any(t in p for t in self.special) for p in parts]
        others = iter(self._by_library([p for p, ok in zip(parts, plain) if not ok]))
        ids_of = self.ranked._core_bpe.encode_to_tiktoken_buffer
        return [np.frombuffer(ids_of(p.decode(), set()), np.uint32).astype(self.kind).tobytes() if ok else next(others) for p, ok in zip(parts, plain)]

    def _by_library(self, parts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]

    def _of(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each part, as bytes."""
        out, new = {}, []
        for p in set(parts):
            got = self.kept.get(p)
            if got is None:
                new.append(p)
            else:
                out[p] = got
        self.reused += len(parts) - len(new)
        self.learned += len(new)
        for a in range(0, len(new), 1000):
            some = new[a : a + 1000]
            for p, ids in zip(some, self._fresh(some)):
                out[p] = ids
                if len(p) < 1 << 14:
                    self.kept.put(p, ids)
        return out

    def encode_all(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        cuts = [cut_places(r, self.span, self.marks) for r in raws]
        parts = [[r[a:b] for a, b in zip([0, *c], [*c, len(r)])] if len(c) else [r] for r, c in zip(raws, (c.tolist() for c in cuts))]
        have = self._of([x for p in parts for x in p if x])
        out: list = []
        plans = []
        for r, c, p in zip(raws, cuts, parts):
            ids = np.frombuffer(b"".join([have[x] for x in p if x]), self.kind)
            out.append(ids)
            if len(c):
                plans.append((len(out) - 1, r, ids, safe_places(r), windows(c, safe_places(r))))
        # The first window of every join of all texts at once; most agree.
        first = self._of([r[safe[a] : safe[b]] for _, r, _, safe, w in plans for a, b, _, _ in w])
        for k, r, ids, safe, w in plans:
            out[k] = self._repair(r, ids, safe, w, first)
        return out

    def _repair(self, raw: bytes, ids: np.ndarray, safe: np.ndarray, todo: list[tuple[int, int, int, int]], first: dict[bytes, bytes]) -> np.ndarray:
        """The ids with every join encoded anew. Windows are (from, to, torn from, torn to), as numbers of safe places."""
        ends = np.cumsum(self.size[ids])
        done, at, k = [], 0, 0
        while k < len(todo):
            a, b, x, y = todo[k]
            self.repaired += 1
            while True:
                # A window that has grown into the next one takes it in.
                while k + 1 < len(todo) and todo[k + 1][0] < b:
                    k += 1
                    b, y = max(b, todo[k][1]), todo[k][3]
                text = raw[safe[a] : safe[b]]
                got = first.get(text)
                new = np.frombuffer(self._fresh([text])[0] if got is None else got, self.kind)
                places = safe[[a, x, y, b]]
                old = np.searchsorted(ends, places, "right")
                own = np.searchsorted(np.cumsum(self.size[new]) + places[0], places, "right")
                whole = self._starts(ends, old, places) & self._starts(np.cumsum(self.size[new]) + places[0], own, places, places[0])
                left = a == x or (whole[0] and whole[1] and np.array_equal(ids[old[0] : old[1]], new[: own[1]]))
                right = b == y or (whole[2] and whole[3] and np.array_equal(ids[old[2] : old[3]], new[own[2] :]))
                if left and right:
                    break
                self.widened += 1
                if not left:
                    x, a = a, max(a - 1, 0)
                if not right:
                    y, b = b, min(b + 1, len(safe) - 1)
            done += [ids[at : old[1]], new[own[1] : own[2]]]
            at = old[2]
            k += 1
        return np.concatenate([*done, ids[at:]])

    @staticmethod
    def _starts(ends: np.ndarray, index: np.ndarray, places: np.ndarray, begin: int = 0) -> np.ndarray:
        """Whether an id begins (or the last one ends) exactly at each place."""
        before = np.where(index > 0, ends[np.maximum(index, 1) - 1] if len(ends) else begin, begin)
        return before == places

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return self.encode_all([text.encode()])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join([self.piece[i] for i in ids]).decode("utf-8", "replace")


def windows(cuts: np.ndarray, safe: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Per join: the torn word lies between two safe places (x, y), and the window takes in a word on each side (a, b), as numbers of safe places. Windows that meet are one."""
    y = np.searchsorted(safe, cuts)
    x = y - 1
    out: list[tuple[int, int, int, int]] = []
    for a, b, p, q in zip(np.maximum(x - 1, 0).tolist(), np.minimum(y + 1, len(safe) - 1).tolist(), x.tolist(), y.tolist()):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2], q)
        else:
            out.append((a, b, p, q))
    return out


@kept_in_worker("bpe_reuse")
@lru_cache(maxsize=2)
def coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


def code_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256 (of what the ids decode to)."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch):
        c = coder(tokenizer_path(tokenizer))
        n, ids, back = [], [], []
        for got in c.encode_all([(t or "").encode() for t in b.column("text").to_pylist()]):
            row = got.tolist()
            n.append(len(row))
            ids.append(hashlib.sha256(b",".join(map(c.decimal.__getitem__, row))).hexdigest())
            back.append(hashlib.sha256(b"".join(map(c.piece.__getitem__, row)).decode("utf-8", "replace").encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(pick(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and the ids themselves."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch):
        c = coder(tokenizer_path(tokenizer))
        ids = [x.astype(np.int32) for x in c.encode_all([(t or "").encode() for t in b.column("text").to_pylist()])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow_map(pick(docs, "doc_id", "text"), run, "doc_id long, ids array<int>")
