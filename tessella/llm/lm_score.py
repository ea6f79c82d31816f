"""LM scoring: a causal self-attention model over subword ids, trained in numpy.

Learning from all documents and scoring run in the executors' JVM where its vectors and a
compiler on the driver are there (lm_kernel), else in numpy workers, with results equal up to rounding.

The model reads the ids of the word vocabulary (one start, the text's ids, one end). One
attention head looks at the last SPAN ids; a hidden layer then gives the next id's class,
and the class gives the id by its share of the class in the training corpus. Windows
overlap by the context, and each id is scored once, in batches with one mask.

Each text is encoded once, into a written table that counting, learning and scoring read.
Counts cover all training documents: words (for the base score) and subword ids. The attention weights learn from all training documents, whole ones of any
length, each once (ROUNDS): each task trains on its own documents and Spark averages the weights.
All tasks start from the same weights, fitted to a few documents (about SAMPLE_DOCS, of long ones
an excerpt of SAMPLE_CHARS characters); these are only where the pass over all of them begins.

Frequent words (at most HEAD, by a threshold on their counts) are counted where the text
is; the others travel as (row, word hash, count) and are joined with the corpus counts.

Cases: a null text counts as empty and is one end; a null doc_id is neither held out nor
learned from; without training documents counts are 0 and the model is uniform over its
classes; an empty table gives an empty result; repeated rows count each; other columns
are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, lm_kernel
from .common import Scratch, id_remainder_col, lean, lower_ascii, one_blas_thread, pick, prepare, tokenizer_path

TOKENIZER, VOCABULARY, END_ID = "word_bpe_49k.json", 49408, 49407
HEAD, SAMPLE_DOCS, SAMPLE_CHARS = 300_000, 800, 20_000
SPAN, STRIDE = 12, 12
WIDTH, HIDDEN, OWN = 16, 32, 2047
#: Classes come in groups of as many: the model gives the group, then the class in it. The last 2 * BINS classes hold the rarer ids.
GROUPS, BINS = 32, 32
STEPS, WINDOWS = 1500, 192
#: Rounds over the corpus after that, as (share of the training documents, rate). The first steps of a task take WINDOWS windows, later ones up to so many times as many.
ROUNDS, LARGEST = ((1.0, 0.003),), 5
#: A task shuffles so many windows, and what makes that number full, before it learns from them.
HELD = 20_000
#: Scores and logits stay within it.
LIMIT = np.float32(30)


def word_hash(w: bytes) -> int:
    """As Spark's xxhash64 of binary."""
    h = xxhash.xxh64_intdigest(w, 42)
    return h - (1 << 64) if h >> 63 else h


# --- counts


def count_words(docs: DataFrame, mod: int, left_out: int) -> DataFrame:
    """word (binary; the empty one is the end of a document), n: over the training documents."""
    rows = pick(docs, "doc_id", "text").where(id_remainder_col(F.col("doc_id"), mod) != left_out)

    def run(batches):
        count: Counter = Counter()

        def out():
            r = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
            count.clear()
            return r

        for b in batches:
            texts = b.column("text").to_pylist()
            for t in texts:
                if t:
                    count.update(lower_ascii(t.encode()).split())
            if texts:
                count[b""] += len(texts)
            if len(count) > 400_000:
                yield out()
        yield out()

    schema = "word binary, n long"
    if lm_kernel.available(docs.sparkSession, (WIDTH, HIDDEN, GROUPS), SPAN, STRIDE):
        parts = lm_kernel.run(rows.select(F.col("text").cast("binary")), "Count", b"", schema)
    else:
        parts = rows.mapInArrow(run, schema)
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def encode_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text and ids (little-endian, two bytes each; a null text has none) of every document, written."""
    prepare(docs.sparkSession)

    def run(batches):
        enc = bpe.word_encoder(tokenizer_path(TOKENIZER), 2)
        for b in batches:
            ids = enc.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("text"), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    return scratch.table(pick(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, text string, ids binary"), "lm-ids")


def count_ids(rows: DataFrame, mod: int, left_out: int) -> np.ndarray:
    """How often each subword id stands in the training documents, from encode_documents()."""

    def run(batches):
        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u2"), minlength=VOCABULARY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    mine = rows.where(id_remainder_col(F.col("doc_id"), mod) != left_out).select("ids")
    got = mine.mapInArrow(lean(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY)
    out[got["id"].to_numpy(int)] = got["n"].to_numpy(float)
    return out


# --- model


@dataclass
class Model:
    """Weights, and per id its input symbol, its class and log10 of its share of the class."""

    p: dict[str, np.ndarray]
    symbol: np.ndarray
    of_class: np.ndarray
    share: np.ndarray
    pad: int
    start: int

    def tables(self) -> dict[str, np.ndarray]:
        p = self.p
        e = p["E"]
        return {"Q": e @ p["Wq"] / np.sqrt(np.float32(WIDTH)), "K": e @ p["Wk"], "V": e @ p["Wv"], "R": e @ p["W1"] + p["c"]}


def vocabulary(counts: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbol, class and log10 share of each id: the commonest ids are classes of their own, the rest goes into bins of about equal mass, apart for ids that end a word."""
    n = counts + 1.0
    order = np.argsort(-n, kind="stable")
    of_class = np.zeros(len(n), np.int32)
    single = GROUPS * GROUPS - 2 * BINS
    of_class[order[:single]] = np.arange(single)
    rest = order[single:]
    for side in (0, 1):
        ids = rest[ends_word[rest] == bool(side)]
        if not len(ids):
            continue
        mass = np.cumsum(n[ids])
        of_class[ids] = single + side * BINS + np.minimum((mass / max(mass[-1], 1) * BINS).astype(int), BINS - 1)
    total = np.bincount(of_class, n, GROUPS * GROUPS)
    symbol = OWN + of_class
    symbol[order[:OWN]] = np.arange(OWN)
    return symbol.astype(np.int32), of_class, np.log10(n / np.maximum(total[of_class], 1))


def _mask() -> np.ndarray:
    """Of STRIDE queries over SPAN + STRIDE - 1 keys: the distance, or -1 where a query may not look."""
    q, k = np.arange(STRIDE)[:, None], np.arange(SPAN + STRIDE - 1)[None]
    d = q + SPAN - 1 - k
    return np.where((d >= 0) & (d < SPAN), d, -1)


_DISTANCE = _mask()


def _windows(model: Model, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input symbols per window, target classes per window (-1: none), the document of each window, and per document its summed log10 shares."""
    groups = [-(-(len(x) + 1) // STRIDE) for x in ids]
    first = np.concatenate([[0], np.cumsum([SPAN - 1 + g * STRIDE for g in groups])]).astype(np.int64)
    sym = np.full(first[-1], model.pad, np.int32)
    tgt = np.full(first[-1], -1, np.int32)
    share = np.zeros(len(ids))
    for k, x in enumerate(ids):
        a = first[k] + SPAN - 1
        sym[a] = model.start
        sym[a + 1 : a + 1 + len(x)] = model.symbol[x]
        tgt[a : a + len(x)] = model.of_class[x]
        tgt[a + len(x)] = model.of_class[END_ID]
        share[k] = model.share[x].sum() + model.share[END_ID]
    of = np.repeat(np.arange(len(ids)), groups)
    at = first[of] + (np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(groups)[:-1]]).astype(np.int64), groups)) * STRIDE
    return sym[at[:, None] + np.arange(SPAN + STRIDE - 1)], tgt[at[:, None] + np.arange(SPAN - 1, SPAN - 1 + STRIDE)], of, share


def _bias(model: Model) -> np.ndarray:
    return np.where(_DISTANCE >= 0, model.p["r"][np.maximum(_DISTANCE, 0)], np.float32(-1e9)).astype(np.float32)


def _forward(model: Model, tables: dict, bias: np.ndarray, sym: np.ndarray):
    """Attention, values, and the hidden layer of each scored place."""
    q = sym[:, SPAN - 1 :]
    s = tables["Q"].take(q, 0) @ tables["K"].take(sym, 0).transpose(0, 2, 1)
    np.clip(s, -LIMIT, LIMIT, out=s)  # keeps exp() finite without a search for each row's largest
    s += bias
    padded = np.flatnonzero(sym[:, 0] == model.pad)  # a document's first windows; what follows its end, no scored place looks at
    if len(padded):
        s[padded] += np.where(sym[padded] == model.pad, np.float32(-1e9), np.float32(0))[:, None, :]
    np.exp(s, out=s)
    s /= (s @ np.ones(s.shape[2], np.float32))[:, :, None]
    v = tables["V"].take(sym, 0)
    h = s @ v
    h += tables["R"].take(q, 0)
    np.maximum(h, 0, out=h)
    return s, v, h


def _heads(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per group, weights and shifts of both levels at once: the logits of all groups, then those of its classes."""
    return np.concatenate([np.broadcast_to(p["U"], (GROUPS, HIDDEN, GROUPS)), p["U2"]], 2), np.concatenate([np.broadcast_to(p["b"], (GROUPS, GROUPS)), p["b2"]], 1)


#: Sums up the first GROUPS columns, and the others.
_LEVELS = np.repeat(np.eye(2, dtype=np.float32), GROUPS, 0)


def score(model: Model, ids: list[np.ndarray], block: int = 1024) -> np.ndarray:
    """log10 probability of each document; each id is scored once."""
    sym, tgt, of, out = _windows(model, ids)
    tables, bias = model.tables(), _bias(model)
    per = np.zeros(len(sym))
    both, shift = _heads(model.p)
    for a in range(0, len(sym), block):
        size = min(block, len(sym) - a)
        hidden = _forward(model, tables, bias, sym[a : a + size])[2].reshape(-1, HIDDEN)
        t = tgt[a : a + size].ravel()
        live = np.flatnonzero(t >= 0)
        live = live[np.argsort(t[live].astype(np.int16), kind="stable")]
        t, h = t[live], hidden.take(live, 0)
        group, within = t // GROUPS, t % GROUPS
        got = np.empty(len(t), np.float32)
        edge = np.searchsorted(group, np.arange(GROUPS + 1))
        for g in range(GROUPS):
            x, y = edge[g], edge[g + 1]
            if y > x:  # both levels at once: the group's logits, then those of its classes
                z = h[x:y] @ both[g]
                z += shift[g]
                np.clip(z, -LIMIT, LIMIT, out=z)
                chosen = z[:, g] + z[np.arange(y - x), GROUPS + within[x:y]]
                np.exp(z, out=z)
                got[x:y] = chosen - np.log(z @ _LEVELS).sum(1)
        per[a : a + size] = np.bincount(live // STRIDE, got, size)
    return out + np.bincount(of, per, len(ids)) / np.log(10)


def fresh(counts: np.ndarray, ends_word: np.ndarray, seed: int = 11) -> Model:
    """A model that knows the classes' shares and nothing of the context; its weights are random."""
    symbol, of_class, share = vocabulary(counts, ends_word)
    classes = GROUPS * GROUPS
    rng = np.random.default_rng(seed)
    n_sym = OWN + classes + 2
    normal = lambda *s, by: (rng.normal(size=s) * by).astype(np.float32)
    p = {"E": normal(n_sym, WIDTH, by=0.3), "Wq": normal(WIDTH, WIDTH, by=0.2), "Wk": normal(WIDTH, WIDTH, by=0.2), "Wv": normal(WIDTH, HIDDEN, by=0.2), "W1": normal(WIDTH, HIDDEN, by=0.3), "c": np.zeros(HIDDEN, np.float32), "r": np.zeros(SPAN, np.float32), "U": normal(HIDDEN, GROUPS, by=0.2), "U2": normal(GROUPS, HIDDEN, GROUPS, by=0.1)}
    mass = np.bincount(of_class, counts + 1.0, classes).reshape(GROUPS, GROUPS) + 1e-9
    p["b"] = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
    p["b2"] = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
    return Model(p, symbol, of_class, share, n_sym - 1, n_sym - 2)


def gradients(model: Model, x: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss of the windows x at the targets t (-1: none)."""
    p, root = model.p, np.sqrt(np.float32(WIDTH))
    tables = model.tables()
    a, v, h = _forward(model, tables, _bias(model), x)
    flat = h.reshape(-1, HIDDEN)
    live = np.flatnonzero(t >= 0)
    live = live[np.argsort(t[live].astype(np.int16), kind="stable")]
    f, group, within = flat.take(live, 0), t[live] // GROUPS, t[live] % GROUPS
    scale = np.float32(1 / max(len(live), 1))
    both, shift = _heads(p)
    d_both, d_shift, df = np.zeros_like(both), np.zeros_like(shift), np.empty_like(f)
    edge = np.searchsorted(group, np.arange(GROUPS + 1))
    for k in range(GROUPS):
        i, j = edge[k], edge[k + 1]
        if j > i:
            z = f[i:j] @ both[k]
            z += shift[k]
            np.clip(z, -LIMIT, LIMIT, out=z)
            np.exp(z, out=z)
            levels = z.reshape(j - i, 2, GROUPS)
            levels *= (scale / (z @ _LEVELS))[:, :, None]
            z[:, k] -= scale
            z[np.arange(j - i), GROUPS + within[i:j]] -= scale
            d_both[k], d_shift[k] = f[i:j].T @ z, np.ones(j - i, np.float32) @ z
            np.matmul(z, both[k].T, out=df[i:j])
    d = {"U": d_both[:, :, :GROUPS].sum(0), "b": d_shift[:, :GROUPS].sum(0), "U2": d_both[:, :, GROUPS:], "b2": d_shift[:, GROUPS:]}
    df *= f > 0
    dflat = np.zeros_like(flat)
    dflat[live] = df
    dh = dflat.reshape(h.shape)
    q = x[:, SPAN - 1 :]
    eq, ek = p["E"].take(q.ravel(), 0), p["E"].take(x.ravel(), 0)
    d["c"] = np.ones(len(dflat), np.float32) @ dflat
    d["W1"] = eq.T @ dflat
    dv = (a.transpose(0, 2, 1) @ dh).reshape(-1, HIDDEN)
    ds = dh @ v.transpose(0, 2, 1)
    ds *= a
    a *= (ds @ np.ones(ds.shape[2], np.float32))[:, :, None]
    ds -= a
    # Of the products by E, before they are divided by the root; the table of Q holds it already.
    dq = (ds @ tables["K"].take(x, 0)).reshape(-1, WIDTH)
    dk = (ds.transpose(0, 2, 1) @ tables["Q"].take(q, 0)).reshape(-1, WIDTH)
    d["r"] = np.bincount(_DISTANCE[_DISTANCE >= 0], ds.sum(0)[_DISTANCE >= 0], SPAN).astype(np.float32)
    d["Wq"] = eq.T @ dq / root
    d["Wk"] = ek.T @ dk
    d["Wv"] = ek.T @ dv
    de = dk @ p["Wk"].T
    de += dv @ p["Wv"].T
    dx = dflat @ p["W1"].T
    dx += dq @ (p["Wq"].T / root)
    de.reshape(*x.shape, WIDTH)[:, SPAN - 1 :] += dx.reshape(*q.shape, WIDTH)
    at = (x.reshape(-1, 1) * WIDTH + np.arange(WIDTH, dtype=x.dtype)).ravel()
    d["E"] = np.bincount(at, de.ravel(), p["E"].size).astype(np.float32).reshape(p["E"].shape)
    return d


class Adam:
    """Steps down the gradients."""

    def __init__(self, model: Model):
        self.model, self.step = model, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))

    def go(self, x: np.ndarray, t: np.ndarray, rate: float) -> None:
        d, p, m, v = gradients(self.model, x, t.ravel()), dict(self.model.p), self.m, self.v
        self.step += 1
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * d[k]
            v[k] = 0.99 * v[k] + 0.01 * d[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**self.step)) / (np.sqrt(v[k] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)
        self.model.p = p


def train(ids: list[np.ndarray], counts: np.ndarray, ends_word: np.ndarray, steps: int | None = None, seed: int = 11) -> Model:
    """The weights that refine() starts from: Adam on windows drawn from a sample."""
    steps = STEPS if steps is None else steps
    one_blas_thread()
    model = fresh(counts, ends_word, seed)
    if not ids:
        model.p["U"][:] = 0
        model.p["U2"][:] = 0
        return model
    rng = np.random.default_rng(seed)
    sym, tgt, _, _ = _windows(model, ids)
    adam = Adam(model)
    for step in range(1, steps + 1):
        drawn = rng.integers(0, len(sym), WINDOWS)
        adam.go(sym[drawn], tgt[drawn], 0.01 * min(1.0, step / 50) * (1 - 0.8 * step / steps))
    return model


def _blob(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].tobytes() for k in sorted(p))


def _unblob(raw: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def average(weights: DataFrame, scratch: Scratch, fan: int = 32) -> bytes | None:
    """The mean of weights (w: bytes of floats, n: windows seen), by n: `fan` rows at a time, so neither a task nor the driver holds more than that many."""

    def run(batches):
        total, n = None, 0
        for b in batches:
            for w, k in zip(b.column("w").to_pylist(), b.column("n").to_pylist()):
                x = np.frombuffer(w, np.float32) * np.float64(k)
                total, n = x if total is None else total + x, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])

    for level in range(64):
        rows = weights.count()
        if rows <= 1:
            got = weights.collect()
            return got[0].w if got else None
        weights = scratch.table(weights.repartition(-(-rows // fan)).mapInArrow(lean(run), "w binary, n long"), f"lm-mean{level}")
    return None


def refine(rows: DataFrame, model: Model, scratch: Scratch, mod: int, left_out: int, share: float, rate: float, salt: int) -> Model:
    """One round over a share of the training documents (1: all), whole ones of any length: each task goes on from the model with the windows of its documents, and the tasks' weights are averaged."""
    rows = rows.select("doc_id", "ids").where(id_remainder_col(F.col("doc_id"), mod) != left_out)
    if share < 1:
        rows = rows.where(F.xxhash64("doc_id", F.lit(salt)).cast("double") / F.lit(2.0**64) + 0.5 < share)
    schema = "w binary, n long"
    if lm_kernel.available(rows.sparkSession, (WIDTH, HIDDEN, GROUPS), SPAN, STRIDE):
        weights = lm_kernel.run(rows.select("ids"), "Learn", lm_kernel.blob(model, SPAN, STRIDE, END_ID), schema, WINDOWS, LARGEST, HELD, rate, salt)
        got = average(scratch.table(weights, "lm-weights"), scratch)
        return model if got is None else replace(model, p=_unblob(got, model.p))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        rng = np.random.default_rng(salt)
        mine = replace(sent.value)
        adam, held, waiting, seen = Adam(mine), [], 0, 0

        def learn():
            nonlocal seen, waiting
            sym, tgt = (np.concatenate(z) for z in zip(*held))
            order, a = rng.permutation(len(sym)), 0
            while a < len(sym):
                at = order[a : a + WINDOWS * min(LARGEST, 1 + adam.step // 20)]
                a += len(at)
                # A part of a batch counts as that part.
                adam.go(sym[at], tgt[at], rate * min(1.0, (adam.step + 1) / 20, len(at) / WINDOWS))
                seen += len(at)
            held.clear()
            waiting = 0

        for b in batches:
            for x in b.column("ids").to_pylist():
                held.append(_windows(mine, [np.frombuffer(x, "<u2")])[:2])
                waiting += len(held[-1][0])
                if waiting > HELD:
                    learn()
        if held:
            learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([_blob(mine.p)], pa.binary()), pa.array([seen], pa.int64())], names=["w", "n"])

    got = average(scratch.table(rows.mapInArrow(lean(run), schema), "lm-weights"), scratch)
    return model if got is None else replace(model, p=_unblob(got, model.p))


class WordCounts:
    """Looks words up among the frequent ones; what isn't found is given as (hash, count) per document."""

    def __init__(self, head: np.ndarray, value: np.ndarray):
        self.head, self.value, self.known = head, np.append(value, 0.0), bpe.Pieces()
        self.end = self._look_up([b""])[b""]

    def _look_up(self, words: list[bytes]) -> dict[bytes, int]:
        """The place among the frequent words, or the hash with its place's bits set aside."""
        h = np.array([word_hash(w) for w in words], np.int64)
        at = np.searchsorted(self.head, h)
        found = (at < len(self.head)) & (self.head[np.minimum(at, len(self.head) - 1)] == h) if len(self.head) else np.zeros(len(h), bool)
        # A hash below the number of frequent words can't be told from a place; one word in 10^13 has such a hash, and none of these is ever taken for another's.
        return dict(zip(words, np.where(found, at, np.where((h >= 0) & (h < len(self.head)), -1 - h, h)).tolist()))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
        """Tokens, tokens found, the sum of the found ones' values, and the others as a list per document; the end is a token."""
        words = [t.split() for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        have = self.known.of(set().union(*words), self._look_up)
        flat = [w for ws in words for w in ws]
        code = np.fromiter(map(have.__getitem__, flat), np.int64, len(flat))
        of = np.repeat(np.arange(len(words)), size)
        found = (code >= 0) & (code < len(self.head))
        hit = np.bincount(of[found], minlength=len(words)).astype(np.int64)
        base = np.bincount(of[found], self.value[code[found]], len(words))
        rare, whose = code[~found], of[~found]
        if 0 <= self.end < len(self.head):
            hit, base = hit + 1, base + self.value[self.end]
        else:
            rare, whose = np.append(rare, np.full(len(words), self.end)), np.append(whose, np.arange(len(words)))
        order = np.lexsort((rare, whose))
        rare, whose = rare[order], whose[order]
        first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (whose[1:] != whose[:-1])])) if len(rare) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(rare)))
        offsets = np.searchsorted(whose[first], np.arange(len(words) + 1))
        pairs = pa.StructArray.from_arrays([pa.array(rare[first]), pa.array(count.astype(np.int32))], names=["h", "k"])
        return size + 1, hit, base, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)


# --- over tables


@dataclass
class Trained:
    """A model with the corpus counts it needs: totals, frequent words (hashes in order, counts), and all words' counts as a table."""

    model: Model
    tokens: int
    distinct: int
    head: np.ndarray
    head_n: np.ndarray
    least: int
    words: DataFrame


def fit(docs: DataFrame, scratch: Scratch, mod: int = 7, left_out: int = 2, head: int = HEAD, rows: DataFrame | None = None) -> Trained:
    """Learns from the documents whose remainder isn't `left_out`; rows: their encode_documents(), if that is there already."""
    prepare(docs.sparkSession)
    rows = encode_documents(docs, scratch) if rows is None else rows
    words = scratch.table(count_words(docs, mod, left_out).withColumn("h", F.xxhash64("word")), "lm-words")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.octet_length("word") == 0, F.col("n"))).alias("d")).collect()[0]
    # A threshold on the counts, from a histogram of at most a few hundred bins, so that at most `head` words reach it.
    bin_of = F.floor(F.log2("n") * 8)
    least, sum_above = 1, 0
    bins = sorted(words.groupBy(bin_of.alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect(), key=lambda r: -r.b)
    for r in bins:
        sum_above += r.k
        if sum_above > head:
            least = r.least
            above = [x.least for x in bins if x.b > r.b]
            least = min(above) if above else 1 << 62
            break
    top = words.where(F.col("n") >= least).select("h", "n").toPandas().sort_values("h")
    counts = count_ids(rows, mod, left_out)
    docs_n = total.d or 0
    counts[END_ID] += docs_n
    share = min(1.0, SAMPLE_DOCS / docs_n) if docs_n else 0.0
    some = pick(docs, "doc_id", "text").where((id_remainder_col(F.col("doc_id"), mod) != left_out) & F.col("text").isNotNull()).withColumn("k", F.xxhash64("doc_id", F.lit(5)))
    # Of a long text, an excerpt at a place that its hash gives.
    at = F.pmod(F.xxhash64("k"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    some = some.withColumn("text", F.substring("text", at, F.lit(SAMPLE_CHARS)))
    some = some.where(F.col("k").cast("double") / F.lit(2.0**64) + 0.5 <= share).orderBy("k", "text").limit(2 * SAMPLE_DOCS)
    texts = [r.text for r in some.select("text").collect()] if docs_n else []
    enc = bpe.WordEncoder(tokenizer_path(TOKENIZER), 2)
    ids = [np.frombuffer(x, "<u2") for x in enc.encode(texts)] if texts else []
    ends = np.zeros(VOCABULARY, bool)
    for token, i in enc.tok.get_vocab(with_added_tokens=True).items():
        ends[i] = token.endswith("</w>")
    model = train(ids, counts, ends)
    for k, (part, rate) in enumerate(ROUNDS if docs_n else ()):
        model = refine(rows, model, scratch, mod, left_out, part, rate, 100 + k)
    return Trained(model, int(total.n or 0), int(total.v), top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64), int(least), words)


def _score_in_python(rows: DataFrame, model: Model, head: np.ndarray, value: np.ndarray, schema: str) -> DataFrame:
    """What LmKernel's Score does, with numpy."""
    shared = rows.sparkSession.sparkContext.broadcast((model, head, value))

    def run(batches):
        model, head, value = shared.value
        counter = WordCounts(head, value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n, hit, base, tail = counter.of([lower_ascii(t.encode()) for t in texts])
            ids = [np.frombuffer(x, "<u2") for x in b.column("ids").to_pylist()]
            lm: list[float] = []
            start = 0
            while start < len(ids):  # so many documents at a time as make about 200,000 ids
                stop, held = start, 0
                while stop < len(ids) and (stop == start or held + len(ids[stop]) < 200_000):
                    held += len(ids[stop])
                    stop += 1
                lm += score(model, ids[start:stop]).tolist()
                start = stop
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n), pa.array(hit), pa.array(base), pa.array(lm, pa.float64()), tail], names=["row", "doc_id", "n_tokens", "hit", "base", "score", "tail"])

    return rows.mapInArrow(lean(run), schema)


def score_documents(docs: DataFrame, trained: Trained, scratch: Scratch, mod: int = 7, left_out: int = 2, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; rows as in fit()."""
    spark = prepare(docs.sparkSession)
    rows = encode_documents(docs, scratch) if rows is None else rows
    smooth = float(np.log10(trained.tokens + trained.distinct + 1))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    schema = "row long, doc_id long, n_tokens long, hit long, base double, score double, tail array<struct<h:bigint,k:int>>"
    value = np.log10(trained.head_n + 1.0)
    if lm_kernel.available(spark, (WIDTH, HIDDEN, GROUPS), SPAN, STRIDE):
        sent = lm_kernel.blob(trained.model, SPAN, STRIDE, END_ID) + lm_kernel.head_blob(trained.head, value)
        got = lm_kernel.run(rows.select("row", "doc_id", F.col("text").cast("binary"), "ids"), "Score", sent, schema)
    else:
        got = _score_in_python(rows, trained.model, trained.head, value, schema)
    got = scratch.table(got.withColumn("held_out", F.coalesce(id_remainder_col(F.col("doc_id"), mod) == left_out, F.lit(False))), "lm-docs")
    rare = got.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.k")
    joined = rare.join(trained.words.where(F.col("n") < trained.least).select("h", "n"), "h")
    # What isn't in the corpus adds log10(0 + 1) = 0, so an inner join is enough.
    per = joined.groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("value"))
    return got.join(per, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hit") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("value", F.lit(0.0)) - F.col("n_tokens") * F.lit(smooth)).alias("base_score"),
        "score",
    )
