"""Exact tokenizer encodings from pieces that are encoded once per worker.

Two facts make the pieces exact. The byte-level vocabulary's pre-tokens never run
from a non-space to a space, so a text may be cut before any white space that
follows something else. The word vocabulary drops white space and its words end at
it, so ids of white-space separated words simply follow one another.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from .common import kept_in_worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A worker keeps so many pieces, none longer than this many bytes, and splits texts of so many characters together (a longer one alone).
PIECES, PIECE_BYTES, TOGETHER = 300_000, 48, 1 << 20
MARK = b"|"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-case letters that neither normalization nor pre-tokenization changes or parts.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Punctuation right behind such a letter; the apostrophe isn't parted (as in 's).
_STOP = re.compile(rb"([!-&(-/:-@\[-`{-~])(?<=[a-z].)")
#: The modules that encode.
USERS = ("bpe_reuse", "lm_score", "packing", "token_file")


@kept_in_worker(*USERS)
@lru_cache(maxsize=2)
def slim(path: str):
    """The vocabulary and merges alone, for words that the file's normalizer and pre-tokenizer leave as they are; and which ids end a word."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        m = json.load(f)["model"]
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    end = m["end_of_word_suffix"]
    t = Tokenizer(models.BPE(vocab=m["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=end, fuse_unk=False))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(max(m["vocab"].values()) + 1, bool)
    for token, i in m["vocab"].items():
        ends[i] = token.endswith(end)
    return t, ends


@kept_in_worker(*USERS)
@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Fixed value: the pattern of byte-level pre-tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@kept_in_worker(*USERS)
@lru_cache(maxsize=4)
def ranked(path: str):
    """An encoder from ranks that gives the library's ids for texts without special tokens, or None if the file doesn't allow it.

    It joins the two neighbours whose joint bytes have the lowest id, whichever merge made
    them. That is the same if ids ascend with the merges, each merge makes another id and
    each token's own bytes are encoded as that token: then a token's bytes have come to
    the two parts of its merge when its turn comes, whatever stands around them.
    """
    import tiktoken
    from tokenizers import Tokenizer, models

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    m, pre = whole["model"], whole["pre_tokenizer"] or {}
    plain = not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if whole["normalizer"] or not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    bytes_of, vocab = byte_alphabet(), m["vocab"]
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    made = [vocab[a + b] for a, b in merges]
    special = {t["content"] for t in whole["added_tokens"]}
    tokens = [t for t in vocab if t not in special]
    if any(a >= b for a, b in zip(made, made[1:])) or not all(c in bytes_of for t in tokens for c in t) or not all(c in vocab for c in bytes_of):
        return None
    if len(tokens) != len(bytes_of) + len(made) or max(vocab[c] for c in bytes_of) > made[0]:
        return None
    bare = Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0))
    if any(e.ids != [vocab[t]] for t, e in zip(tokens, bare.encode_batch_fast(tokens, add_special_tokens=False))):
        return None
    return tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL, mergeable_ranks={bytes(bytes_of[c] for c in t): vocab[t] for t in tokens}, special_tokens={})


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """What is known of pieces: two generations, each of at most half as many. What is used of the old one moves to the new one."""

    def __init__(self, most: int = PIECES):
        self.new, self.old, self.half = {}, {}, most // 2

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def of(self, wanted: set[bytes], learn) -> dict:
        """A dictionary that has every wanted piece; learn() makes those that aren't known."""
        missing = wanted.difference(self.new)
        if not missing:
            return self.new
        again = {w: self.old[w] for w in missing.intersection(self.old)}
        again |= learn([w for w in missing if w not in again])
        keep = {w: v for w, v in again.items() if len(w) <= PIECE_BYTES}
        if len(self.new) + len(keep) <= self.half:
            self.new.update(keep)
            if len(keep) == len(again):
                return self.new
            return {w: again[w] if w in again else self.new[w] for w in wanted}
        out = {w: again[w] if w in again else self.new[w] for w in wanted}
        self.old = self.new
        self.new = {w: v for w, v in list(out.items())[: self.half] if len(w) <= PIECE_BYTES}
        return out


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them for a vocabulary that drops white space; little-endian bytes of `width` per id."""

    def __init__(self, path: str, width: int = 4, most: int = PIECES):
        self.tok, self.kind, self.known = load(path), f"<u{width}", Pieces(most)
        self.slim, self.ends = slim(path)
        (self.mark,) = self.tok.encode(MARK.decode(), add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out, first, size = [], 0, 0
        for k, t in enumerate(texts):
            if size and size + len(t) > TOGETHER:
                out += self._encode(texts[first:k])
                first, size = k, 0
            size += len(t)
        return out + self._encode(texts[first:])

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t.encode()) for t in texts]
        have = self.known.of(set().union(*split), self.learn)
        return [b"".join(map(have.__getitem__, words)) for words in split]

    @staticmethod
    def pieces(raw: bytes) -> list[bytes]:
        """The vocabulary lowers letters, and parts punctuation from a letter before it; doing so first makes more pieces alike. A text that may hold a special token's string is left as it is."""
        if b"|>" in raw:
            return raw.split()
        return _STOP.sub(rb" \1", raw.translate(_LOWER)).split()

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Encodes words in long rows. Plain words go through the bare vocabulary and are parted by the ids that end a word; others through the whole tokenizer, parted by a mark of one id; words that may hold the mark or a special token go alone."""
        got: dict[bytes, bytes] = {}
        plain, rest, odd = [], [], []
        for w in words:
            (plain if _PLAIN.fullmatch(w) else odd if MARK in w or b"|>" in w else rest).append(w)
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            ids = np.array(self.slim.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.kind)
            self._deal(part, ids, np.flatnonzero(self.ends[ids]) + 1, 0, got, odd)
        for a in range(0, len(rest), 2000):
            part = rest[a : a + 2000]
            row = b" ".join([x for w in part for x in (w, MARK)]).decode()
            ids = np.array(self.tok.encode_batch_fast([row], add_special_tokens=False)[0].ids, self.kind)
            self._deal(part, ids, np.flatnonzero(ids == self.mark), 1, got, odd)
        for w, e in zip(odd, self.tok.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)):
            got[w] = np.array(e.ids, self.kind).tobytes()
        return got

    @staticmethod
    def _deal(part: list[bytes], ids: np.ndarray, ends: np.ndarray, skip: int, got: dict, odd: list) -> None:
        if len(ends) != len(part):
            odd += part
            return
        raw, width, start = ids.tobytes(), ids.itemsize, 0
        for w, e in zip(part, (ends * width).tolist()):
            got[w] = raw[start:e]
            start = e + skip * width


@kept_in_worker(*USERS)
@lru_cache(maxsize=4)
def word_encoder(path: str, width: int = 4) -> WordEncoder:
    return WordEncoder(path, width)
