"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest match from each
place of a text; parsing the text into such matches, the language that needs the fewest
phrases wins, times the logarithm of its sample's length, since longer samples have longer
matches (ties: the first by name). Each language has its own alphabet: all characters
of its sample. Whole texts are parsed: blocks of a fixed length step through the automaton's
table together as if each began a phrase, then each is gone through again from the state in
which the block before ended, up to where both parses are in the same state. Where the
alphabet is large (Chinese), the table is a sorted list of transitions.

Cases: a null text, or one without a letter, is `und` with score 0; with nothing to learn
from, every text is `und`; a null doc_id is not held out and never learned from; an empty
table gives an empty result; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, id_remainder, id_remainder_col, kept_in_worker, pick, positional, prepare

#: The classifier's sample of labelled rows: so many languages (those with most documents), documents of each about, and characters of each.
MAX_LANGUAGES, SAMPLE_DOCS, SAMPLE_CHARS = 200, 200, 30_000
#: Alphabets up to so many characters have a full table of transitions.
DENSE, BLOCK, LANES = 126, 256, 4096


@dataclass(frozen=True)
class Model:
    """Sample text per language, in order of name; the automata are built where they are needed."""

    samples: tuple[tuple[str, str], ...]

    @property
    def digest(self) -> str:
        return hashlib.sha256(repr(self.samples).encode()).hexdigest()


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of seq, per state."""
    link, length = [-1], [0]
    nxt: list[dict[int, int]] = [{}]
    last = 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class Dense:
    """Per state and symbol: twice the next state's row start, plus 1 if a phrase ends before the symbol."""

    def __init__(self, nxt: list[dict[int, int]], size: int):
        pad, other = size + 1, len(nxt)
        go = np.full((len(nxt) + 1, size + 2), -1, np.int32 if (len(nxt) + 1) * (size + 2) * 2 < 2**31 else np.int64)
        for s, d in enumerate(nxt):
            for c, t in d.items():
                go[s, c] = t
        # In place, since every worker holds such a table per language. The last state follows a character of no sample, which is a phrase by itself.
        root = np.where(go[0] >= 0, go[0], 0)
        root[0] = other
        missing = go < 0
        np.copyto(go, root[None, :], where=missing)
        missing[0] = False  # nothing ends before the first character
        go *= (size + 2) * 2
        go += missing
        go[:, pad] = np.arange(len(go)) * (size + 2) * 2
        self.table = go.ravel()

    def step(self, at: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and 1 where a phrase ends before the symbol."""
        v = self.table.take(at + symbols)
        return v >> 1, v & 1


class Sparse:
    """The same from the sorted keys (state, symbol) of the transitions there are."""

    def __init__(self, nxt: list[dict[int, int]], size: int):
        self.width, self.pad = size + 2, size + 1
        pairs = sorted((s * self.width + c, t) for s, d in enumerate(nxt) for c, t in d.items())
        self.keys, self.to = np.array([k for k, _ in pairs] + [2**62], np.int64), np.array([t for _, t in pairs] + [0], np.int64)
        self.root = np.zeros(self.width, np.int64)
        self.root[0] = len(nxt)  # after a character of no sample
        for c, t in nxt[0].items():
            self.root[c] = t

    def step(self, at: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = at * self.width + symbols
        i = np.searchsorted(self.keys, key)
        hit, live = self.keys.take(i) == key, symbols != self.pad
        return np.where(live, np.where(hit, self.to.take(i), self.root.take(symbols)), at), (live & ~hit & (at != 0)).astype(np.int64)


def count_breaks(table, rows: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that end within each column of symbols, in a parse that goes on from the column before where `follows`."""
    lanes = rows.shape[1]
    kind = table.table.dtype if isinstance(table, Dense) else np.int64
    at, n = np.zeros(lanes, kind), np.zeros(lanes, np.int64)
    states, sums = np.empty(rows.shape, kind), np.empty(rows.shape, np.int16)
    for i, symbols in enumerate(rows):
        at, b = table.step(at, symbols)
        n += b
        states[i], sums[i] = at, n
    whole, end = n.copy(), at.copy()
    redo = np.flatnonzero(follows)
    while len(redo):
        was = end[redo].copy()
        live, at, got = np.arange(len(redo)), end[redo - 1], np.zeros(len(redo), np.int64)
        for i, symbols in enumerate(rows):
            lane = redo[live]
            at, b = table.step(at, symbols.take(lane))
            got[live] += b
            met = at == states[i].take(lane)
            if met.any():
                done = live[met]
                n[redo[done]] = got[done] + whole[redo[done]] - sums[i].take(redo[done])
                end[redo[done]] = states[-1].take(redo[done])
                live, at = live[~met], at[~met]
                if not len(live):
                    break
        if len(live):  # no state in common in the whole column
            n[redo[live]], end[redo[live]] = got[live], at
        # A column whose end has changed changes the one after it.
        changed = redo[end[redo] != was] + 1
        redo = changed[changed < lanes]
        redo = redo[follows[redo]]
    return n


class Parser:
    """Counts the phrases of many texts for one set of languages."""

    def __init__(self, model: Model):
        self.langs = [k for k, _ in model.samples]
        #: What a phrase costs: the logarithm of the places it may come from.
        self.weight = np.array([np.log2(len(text) + 2) for _, text in model.samples])
        held = [np.frombuffer(text.lower().encode("utf-32-le"), np.uint32) for _, text in model.samples]
        chars = np.unique(np.concatenate([*held, np.zeros(0, np.uint32)]))
        #: Symbol 0: a character of no sample; the last: padding.
        self.pad = len(chars) + 1
        self.symbol = np.zeros(int(chars[-1]) + 2 if len(chars) else 1, np.min_scalar_type(self.pad))
        self.symbol[chars] = np.arange(1, len(chars) + 1)
        #: Per language: its own symbols (0: not in its sample) of the symbols above, and its transitions.
        self.own, self.tables = [], []
        for u in held:
            s = self.symbol[u]
            mine = np.unique(s)
            own = np.zeros(self.pad + 1, np.min_scalar_type(len(mine) + 1))
            own[mine] = np.arange(1, len(mine) + 1)
            own[self.pad] = len(mine) + 1
            self.own.append(own)
            self.tables.append((Dense if len(mine) <= DENSE else Sparse)(suffix_automaton(own[s].tolist()), len(mine)))

    def symbols(self, text: str) -> np.ndarray:
        u = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        return self.symbol[np.minimum(u, len(self.symbol) - 1)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases per text and language, in one matrix."""
        out = np.ones((len(texts), len(self.langs)), np.int64)
        start = 0
        while start < len(texts):  # so many texts at a time as fill the lanes; a longer text goes by itself
            rows, owner = [], []
            while start < len(texts) and (not rows or sum(map(len, rows)) < LANES * BLOCK):
                s = self.symbols(texts[start])
                n = -(-len(s) // BLOCK)
                padded = np.full(n * BLOCK, self.pad, self.symbol.dtype)
                padded[: len(s)] = s
                rows.append(padded)
                owner.append(np.full(n, start))
                start += 1
            blocks, of = np.ascontiguousarray(np.concatenate(rows).reshape(-1, BLOCK).T), np.concatenate(owner)
            follows = np.concatenate([[False], of[1:] == of[:-1]])[: len(of)]
            mine = np.empty(blocks.shape, self.symbol.dtype)
            for k, table in enumerate(self.tables):
                for i, row in enumerate(blocks):  # by rows, since take() makes eight bytes of each symbol
                    mine[i] = self.own[k].take(row)
                np.add.at(out[:, k], of, count_breaks(table, mine, follows))
        return out


@kept_in_worker("language_id")
@lru_cache(maxsize=1)
def _parser(digest: str, model: Model) -> Parser:
    return Parser(model)


def learn(docs: DataFrame, mod: int = 4, left_out: int = 2) -> Model:
    """Sample text per language from the rows whose remainder isn't `left_out`: texts with the smallest id hashes, of long ones an excerpt, until SAMPLE_CHARS."""
    rows = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder_col(F.col("doc_id"), mod) != left_out))
    per = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not per:
        return Model(())
    share = F.create_map(*[x for r in per for x in (F.lit(r["lang"]), F.lit(min(1.0, SAMPLE_DOCS / r["count"])))])
    h = F.xxhash64("doc_id")
    near = rows.withColumn("h", h).where((F.col("h").cast("double") / F.lit(2.0**64)) + 0.5 < share[F.col("lang")])
    # Of a long text, an excerpt at a place that its hash gives.
    most = SAMPLE_CHARS // 3
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int") + 1
    near = near.select("h", "doc_id", "lang", F.substring(F.col("text"), start, F.lit(most)).alias("text"))
    cut = near.orderBy("h", "doc_id", "text").limit(2 * SAMPLE_DOCS * len(per)).collect()
    text: dict[str, list[str]] = {}
    for r in cut:
        if sum(map(len, text.setdefault(r.lang, []))) < SAMPLE_CHARS:
            text[r.lang].append(r.text)
    return Model(tuple((k, "\n".join(v)[: 2 * SAMPLE_CHARS]) for k, v in sorted(text.items())))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, phrase_rate double"


def judge(texts: list[str | None], model: Model) -> list[tuple[str, float, float | None]]:
    """(language, score, phrases a character in it) of each text. Score: how much less the winner's phrases cost than the runner-up's, as a share."""
    live = [i for i, t in enumerate(texts) if t and model.samples and any(map(str.isalpha, t))]
    out: list[tuple[str, float, float | None]] = [("und", 0.0, None)] * len(texts)
    if live:
        p = _parser(model.digest, model)
        got = p.phrases([texts[i] for i in live])
        for i, row in zip(live, got):
            cost = row * p.weight
            k = int(cost.argmin())
            rest = np.delete(cost, k)
            out[i] = (p.langs[k], float(1 - cost[k] / rest.min()) if len(rest) else 1.0, float(row[k] / len(texts[i])))
    return out


def predict(docs: DataFrame, model: Model, mod: int = 4, left_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and phrase_rate of every document."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch):
        ids = b.column("doc_id").to_pylist()
        got = judge(b.column("text").to_pylist(), model)
        held = [id_remainder(i, mod) == left_out for i in ids]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "phrase_rate"])

    return arrow_map(pick(docs, "doc_id", "text"), run, SCHEMA)


def limits(model: Model, max_rate: float) -> dict[str, float]:
    """The highest rate of phrases that a text of each language may have: max_rate, or a quarter over the rate of one half of the sample parsed by the other, where a language (Chinese) has short phrases itself."""
    out = {}
    for k, text in model.samples:
        half = len(text) // 2
        rate = Parser(Model(((k, text[:half]),))).phrases([text[half:]])[0, 0] / max(1, len(text) - half)
        out[k] = max(max_rate, min(0.95, 1.25 * float(rate)))
    return out


def keep_known(docs: DataFrame, model: Model, max_rate: float = 0.6) -> DataFrame:
    """The rows in one of the learned languages, with all their columns: not `und`, and not parsed into phrases so short (1 / max_rate characters, or see limits) that the text is in none of them."""
    prepare(docs.sparkSession)
    most = limits(model, max_rate)
    plain, at = positional(docs)
    names, text = plain.columns, at["text"]

    def run(b: pa.RecordBatch):
        got = judge(b.column(names.index(text)).to_pylist(), model)
        yield b.filter(pa.array([g[0] != "und" and g[2] <= most[g[0]] for g in got], pa.bool_()))

    return arrow_map(plain, run, T.StructType(plain.schema.fields)).toDF(*docs.columns)
