"""N-gram Jaccard join with PartEnum signatures.

A text's set holds its distinct word shingles, as 64-bit hashes. Two sets r and s with Jaccard
similarity of at least g differ in at most (1 - g) / (1 + g) * (|r| + |s|) = k elements. Sets
are put into bands of sizes; a set has signatures for its own band and for the one before, if
a similar smaller set may lie there. Per band the hash domain is cut into more than k / 2
groups of three parts. At least one group holds at most one of the differing elements, so
two of its three parts hold the same elements of both sets: the signatures of a set are
hashes of its elements in each two of the three parts of each group.

What stands in many texts would make equal signatures by chance. So the domain is cut in two
by a bitmap of common shingles, and signatures are made of the rest. A group is rich if each
two of its parts hold a rare shingle; a set with more than k / 2 rich groups agrees with each
similar set in two parts that aren't empty. Sets that have too few rich groups have
signatures of all their shingles as well, of empty parts too if those are too few again. Any
bitmap gives the same links, so it is made from a bounded sample of texts.

Equal sets are one class, so copies are never paired. In each group of equal signatures
every class is paired with the smallest one (a star), which is linear in the group;
pairs are verified on whole sets. Rounds of stars between the groups' components follow.
Classes of one group that then still lie in different components are compared by sizes and
sketches in tiles, which can't rule out a link wrongly; a tile gives a spanning forest of what
it can't rule out. The classes of each tree of all forests are compared on whole sets in
tiles again, and a tile gives those links alone that join two components. So every pair that
shares a signature was verified, ruled out or is connected anyway, and no step gives more
rows than it has read.

Cases: a null or wordless text has the empty set and is linked with nothing; fewer words
than a shingle: one shingle of them all; an empty table gives an empty result; rows with a
null doc_id count as members but never name a component unless all its doc_ids are null;
repeated rows have equal sets; other columns are ignored by components(). Elements and
classes are 64-bit hashes: among 10^9 different sets one false union is expected at
under 3 percent.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, join_hot, lean, lower_ascii, pick, positional, prepare
from .components import connected
from .license_scan import grams_of

SHINGLE, PERCENT, ROUNDS = 5, 80, 2


#: Texts are hashed together up to so many bytes, which the caches hold; words of over so many bytes are hashed one by one.
BLOCK, WORD = 1 << 18, 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that lie at starts to ends of x, which holds eight bytes more than the last word needs.

    A word is read as integers of eight bytes. Each step is a bijection of them, so words of one length of at most eight bytes never collide.
    """
    n = ends - starts
    load = np.ndarray((len(x) - 7,), "<u8", x, strides=(1,))
    h = n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (load[starts] & _MASK[np.minimum(n, 8)])) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    for k in range(8, WORD, 8):
        at = np.flatnonzero(n > k)
        if not len(at):
            break
        g = (h[at] ^ (load[starts[at] + k] & _MASK[np.minimum(n[at] - k, 8)])) * np.uint64(0x9E3779B97F4A7C15)
        h[at] = g ^ (g >> np.uint64(32))
    for i in np.flatnonzero(n > WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(x[starts[i] : ends[i]])
    return h


def sets_of(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order; a null or wordless text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        x = np.frombuffer(lower_ascii(data.slice(off[i], off[j] - off[i]).to_pybytes()) + b" " * 8, np.uint8)
        cut = off[i : j + 1] - off[i]
        word = ((x - np.uint8(9)) > 4) & (x != 32)
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        for edge, at in ((first, cut[:-1]), (last, cut[cut > 0] - 1)):  # words end with their text
            edge[at] = word[at]
        starts = np.flatnonzero(first)
        h = word_hashes(x, starts, np.flatnonzero(last) + 1)
        grams = grams_of(h, size)
        bounds = np.searchsorted(starts, cut).tolist()
        for p, q in zip(bounds, bounds[1:]):
            s = np.sort(grams[p : q - size + 1] if q - p >= size else grams_of(h[p:q], q - p) if q > p else h[:0])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s if new.all() else s[new]
        i = j


def key_of(s: np.ndarray) -> int:
    """A class of equal sets."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class PartEnum:
    """Signatures of sets for a similarity of percent / 100 or more: groups of three parts, of which each two are a signature."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        #: Bands of sizes, each up to 1 / g^2 as large as its smallest.
        self.low, self.high = [1], []
        while self.low[-1] < 1 << 40:
            self.high.append(max(self.low[-1], floor(self.low[-1] * 10_000 / percent**2)))
            self.low.append(self.high[-1] + 1)
        self.high.append(1 << 62)
        self._low = np.array(self.low)

    def distance(self, total: int) -> int:
        """The most elements in which two similar sets of `total` elements together differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def differ(self, n: int) -> int:
        """The most elements in which a set of n and a similar one that is no smaller differ."""
        return self.distance(n + n * 100 // self.percent)

    def groups(self, band: int) -> int:
        """More than half of what two sets may differ by, of which the smaller one is in the band; some more, since a few have empty parts."""
        k = self.differ(self.high[band])
        return k // 2 + 1 + (ceil(0.04 * k) if k > 8 else 0)

    def bands(self, n: int) -> list[int]:
        """The set's own band, and the one before if a similar smaller set may lie there. A band of equal sets only has no signatures."""
        band = int(np.searchsorted(self._low, n, "right")) - 1
        both = [band] + ([band - 1] if band and n * self.percent <= self.high[band - 1] * 100 else [])
        return [j for j in both if self.differ(self.high[j])]

    def signatures(self, s: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        n = len(s)
        out = []
        rare = s if common is None else s[~common]
        for j in self.bands(n) if n else ():
            enough = min(self.differ(n), self.differ(self.high[j])) // 2 + 1
            g, rich = self._of(rare, j, 0, -1)
            out.append(g)
            if rich < enough:
                out.append(self._of(s, j, 1, enough)[0])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _of(self, s: np.ndarray, j: int, tag: int, enough: int) -> tuple[np.ndarray, int]:
        """Signatures of each two parts of a group that aren't both empty, and of the empty ones if fewer than `enough` groups are rich; and how many are rich."""
        m = self.groups(j)
        sums, held = np.zeros(3 * m, np.uint64), np.zeros(3 * m, bool)
        if len(s):
            mixed = s * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            part = ((s >> np.uint64(32)) * np.uint64(3 * m)) >> np.uint64(32)  # ascends with s
            start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            at = part[start].astype(np.int64)
            sums[at], held[at] = np.add.reduceat(mixed, start), True
        sums, held = sums.reshape(m, 3), held.reshape(m, 3)
        rich = int((held.sum(1) > 1).sum())
        two = (sums[:, _ONE] + sums[:, _OTHER]).ravel()
        number = np.arange(3 * m, dtype=np.uint64)
        if rich >= enough:
            live = (held[:, _ONE] | held[:, _OTHER]).ravel()
            two, number = two[live], number[live]
        g = (two ^ (number * np.uint64(0x9E3779B97F4A7C15) + np.uint64((2 * j + tag) * 0x2545F491 + 1))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return g ^ (g >> np.uint64(31)), rich


_ONE, _OTHER = np.array([0, 0, 1]), np.array([1, 2, 2])

#: The sample of texts that the bitmap of common shingles is made from, how many of them make a shingle common, and the bitmap's bits.
SAMPLE, COMMON, COMMON_BITS = 8_000, 3, 1 << 24


def common_shingles(docs: DataFrame, size: int = SHINGLE) -> bytes:
    """A bitmap of fixed size of the shingles that at least COMMON sampled texts hold."""
    rows = pick(docs, "text")
    share = min(1.0, SAMPLE / max(1, rows.count()))
    rows = rows.where(F.xxhash64(F.monotonically_increasing_id()).cast("double") / F.lit(2.0**64) + 0.5 < share)

    def run(batches):
        seen = set()
        for b in batches:
            for s in sets_of(b.column("text"), size):
                if len(s) and (k := key_of(s)) not in seen:
                    seen.add(k)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["h"])

    held = rows.mapInArrow(lean(run), "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    return bitmap(held, "h", COMMON_BITS)


def is_common(s: np.ndarray, bits: np.ndarray) -> np.ndarray:
    h = s & np.uint64(COMMON_BITS - 1)
    return (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0


def signature_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """sig, key of the classes that share a signature with another class; a class once per signature.

    One shuffle by signature; each partition is sorted and read as a stream, so a group's
    size doesn't matter for memory. A task sends a class once, however many copies it has.
    """

    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    def emit(batches):
        pe, seen, bits = PartEnum(percent), set(), np.frombuffer(common.value, np.uint8)
        for b in batches:
            sigs, keys, count = [], [], []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), count))], names=["sig", "key"])

            held = 0
            for s in sets_of(b.column("text"), size):
                if not len(s):
                    continue
                k = key_of(s)
                if k in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(k)
                g = pe.signatures(s, is_common(s, bits))
                sigs.append(g)
                keys.append(k)
                count.append(len(g))
                held += len(g)
                if held > 400_000:
                    yield out()
                    sigs, keys, count, held = [], [], [], 0
            if sigs:
                yield out()

    def groups(batches):
        """Rows ascend by sig, then key. Gives the distinct rows of signatures that have two keys or more."""
        last_sig = last_key = held = None  # the row before; held: it was the first of its signature and isn't given yet
        for b in batches:
            sig, key = b.column("sig").to_numpy(), b.column("key").to_numpy()
            if not len(sig):
                continue
            same_sig = np.empty(len(sig), bool)
            same_sig[1:] = sig[1:] == sig[:-1]
            same_sig[0] = last_sig is not None and sig[0] == last_sig
            same = same_sig.copy()
            same[1:] &= key[1:] == key[:-1]
            same[0] = same[0] and key[0] == last_key
            at = np.flatnonzero(~same)
            if len(at):
                s, k, follows = sig[at], key[at], same_sig[at]
                shared = follows.copy()
                shared[:-1] |= follows[1:]
                out_s, out_k = s[shared], k[shared]
                if follows[0] and held:
                    out_s, out_k = np.concatenate([[last_sig], out_s]), np.concatenate([[held[0]], out_k])
                if len(out_s):
                    yield pa.RecordBatch.from_arrays([pa.array(out_s.astype(np.int64)), pa.array(out_k.astype(np.int64))], names=["sig", "key"])
                held = None if shared[-1] else (int(k[-1]),)
            last_sig, last_key = sig[-1], key[-1]

    made = pick(docs, "text").mapInArrow(lean(emit), "sig long, key long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return made.repartition(n, "sig").sortWithinPartitions("sig", "key").mapInArrow(lean(groups), "sig long, key long")


def members(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n and key of every row; sketch and elements (sorted 8-byte hashes) with the first row of each wanted class in a task, and of a few others."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "key", BITS))

    def run(batches):
        mask, seen = np.frombuffer(bits.value, np.uint8), set()
        for b in batches:
            n, keys, marks, got = [], [], [], []
            for s in sets_of(b.column("text"), size):
                k = key_of(s)
                h = k & (BITS - 1)
                first = len(s) and (mask[h >> 3] >> (h & 7)) & 1 and k not in seen
                if first:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(k)
                n.append(len(s))
                keys.append(k)
                marks.append(sketch(s) if first else None)
                got.append(s.tobytes() if first else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(marks, pa.binary()), pa.array(got, pa.binary())], names=["doc_id", "n", "key", "sketch", "elements"])

    return pick(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, key long, sketch binary, elements binary")


def sketch(s: np.ndarray) -> bytes:
    """How many elements a set has in each of CELLS parts of the domain, up to 255 each."""
    return np.minimum(np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


#: Parts of a sketch; rows of a tile's sides, and elements where whole sets are compared; bits of the bitmap that spares the writing of most sets that aren't wanted.
CELLS, TILE, TILE_ELEMENTS, BITS = 256, 1500, 2_000_000, 1 << 23


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs a, b whose sets are similar enough.

    Sizes and sketches come first: what two sketches differ by is a lower bound of what the sets differ by, so only pairs that it can't rule out fetch their whole sets.
    """
    small = sets.select("key", "n", "sketch")
    sized = pairs.join(small.toDF("a", "n", "x"), "a").join(small.toDF("b", "m", "y"), "b").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)

    def may(batches):
        for b in batches:
            n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in "xy")
            ok = np.abs(x - y).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (n + m)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):  # one pair's sets at a time
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    likely = sized.select("a", "b", "n", "m", "x", "y").mapInArrow(lean(may), "a long, b long")
    whole = sets.select("key", "elements")
    return likely.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _tiles(rows: DataFrame, group: str, blocks: DataFrame) -> DataFrame:
    """The rows once per tile of their group (columns lo, hi, own come first): the group's rows are dealt over so many blocks, and each two blocks are a tile."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.join(blocks, group).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return out.drop("blocks", "other").repartition(n, group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def _each_tile(batches, group: str, names: tuple[str, ...], compare):
    """Gathers each tile's rows and gives the pairs that compare() makes of them, as batches."""
    tile: dict[str, list] = {c: [] for c in names}
    found: list[tuple[int, int]] = []

    def batch():
        out = sorted(set(found))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in names]):
            if tile["lo"] and (tile[group][0], tile["lo"][0], tile["hi"][0]) != row[:3]:
                if len(tile["lo"]) > 1:
                    found += compare(tile)
                tile = {c: [] for c in names}
            for c, v in zip(names, row):
                tile[c].append(v)
        if len(found) > 200_000:
            yield batch()
    if len(tile["lo"]) > 1:
        found += compare(tile)
    yield batch()


def _compare(tile: dict[str, list], percent: int, linked=None, parted: bool = True) -> list[tuple[int, int]]:
    """Pairs of keys that join two trees of a forest over the tile: pairs of different components that sizes and sketches can't rule out and, if given, linked(i, j) confirms.

    Trees are those of the pairs given (parted: at first each key is one by itself), or the components and the pairs given.
    """
    own, key, size = (np.array(tile[c]) for c in ("own", "key", "n"))
    root = np.unique(np.array(tile["root"]), return_inverse=True)[1]
    marks = np.frombuffer(b"".join(tile["sketch"]), np.uint8).reshape(-1, CELLS).astype(np.int16)
    tree = np.arange(len(key)) if parted else root.copy()
    lo = tile["lo"][0]
    left = np.flatnonzero(own == lo)
    right = left if lo == tile["hi"][0] else np.flatnonzero(own != lo)
    out = []
    for i in left.tolist():
        j = right[right > i] if right is left else right
        j = j[(root[j] != root[i]) & (tree[j] != tree[i]) & (np.minimum(size[j], size[i]) * 100 >= np.maximum(size[j], size[i]) * percent)]
        if len(j):
            far = np.abs(marks[j] - marks[i]).sum(1, dtype=np.int64)
            j = j[far * (100 + percent) <= (100 - percent) * (size[j] + size[i])]
        for x in j.tolist():
            if tree[x] != tree[i] and (linked is None or linked(i, x)):
                out.append((int(min(key[i], key[x])), int(max(key[i], key[x]))))
                tree[tree == tree[x]] = tree[i]
    return out


def likely(live: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: per tile of a signature's group a spanning forest of the classes of different components (sig, key, root) that sizes and sketches can't rule out."""
    blocks = live.groupBy("sig").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    names = ("sig", "lo", "hi", "own", "key", "root", "n", "sketch")
    rows = _tiles(live.join(sets.select("key", "n", "sketch"), "key"), "sig", blocks).select(*names)

    def run(batches):
        yield from _each_tile(batches, "sig", names, lambda t: _compare(t, percent))

    return rows.mapInArrow(lean(run), "a long, b long")


def settle(trees: DataFrame, comps: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links that join two components, among the classes of each tree (key, tree), compared on whole sets."""
    held = trees.join(comps.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")).join(sets, "key")
    blocks = trees.join(sets.select("key", "n"), "key").groupBy("tree").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_ELEMENTS)).cast("int").alias("blocks"))
    names = ("tree", "lo", "hi", "own", "key", "root", "n", "sketch", "elements")

    def run(batches):
        def compare(tile):
            whole = [np.frombuffer(x, np.uint64) for x in tile["elements"]]

            def linked(i, j):
                p, q = (whole[i], whole[j]) if len(whole[i]) <= len(whole[j]) else (whole[j], whole[i])
                both = int((q.take(np.searchsorted(q, p), mode="clip") == p).sum())
                return 100 * both >= percent * (len(p) + len(q) - both)

            return _compare(tile, percent, linked, False)

        yield from _each_tile(batches, "tree", names, compare)

    return _tiles(held, "tree", blocks).select(*names).mapInArrow(lean(run), "a long, b long")


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id of its component)."""
    spark = prepare(docs.sparkSession)
    scratch = scratch or Scratch(spark)
    groups = scratch.table(signature_groups(docs, size, percent), "pe-groups")
    all_rows = scratch.table(members(docs, groups.select("key").distinct(), size), "pe-members")
    sets = scratch.table(all_rows.where("elements is not null").select("key", "n", "sketch", "elements").dropDuplicates(["key"]), "pe-sets")
    links = comps = None
    for k in range(ROUNDS + 1):
        if comps is None:
            pairs = groups.groupBy("sig").agg(F.min("key").alias("a")).join(groups, "sig").select("a", F.col("key").alias("b")).where("a <> b").distinct()
            tested = None
        else:
            with_root = groups.join(comps, groups.key == comps.node, "left").select("sig", "key", F.coalesce("root", "key").alias("root"))
            open_sigs = with_root.groupBy("sig").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("sig")
            live = scratch.table(with_root.join(open_sigs, "sig"), f"pe-live{k}")
            if live.isEmpty():
                break
            if k == ROUNDS:  # what is left to compare in each group
                forest = connected(scratch.table(likely(live, sets, percent), "pe-likely"), scratch)
                trees = scratch.table(forest.select(F.col("node").alias("key"), F.col("root").alias("tree")), "pe-trees")
                found = scratch.table(settle(trees, comps, sets, percent), f"pe-links{k}")
                comps = scratch.table(connected(links.unionByName(found), scratch), f"pe-comps{k}")
                break
            # One class per component and signature, another one in each round, paired with the smallest.
            order = F.xxhash64("sig", "key", F.lit(k))
            reps = live.groupBy("sig", "root").agg(F.min_by("key", order).alias("key"))
            first = reps.groupBy("sig").agg(F.min_by("key", F.xxhash64("sig", "root", F.lit(k))).alias("a"))
            pairs = reps.join(first, "sig").select("a", F.col("key").alias("b")).where("a <> b").distinct()
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = scratch.table(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"pe-pairs{k}")
        found = scratch.table(verify(pairs, sets, percent), f"pe-links{k}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        comps = scratch.table(connected(links, scratch), f"pe-comps{k}")
    for name in ("pe-groups", "pe-sets"):
        scratch.drop_table(name)
    # Names of components, then of classes, then of documents; hot ones are broadcast instead of gathered.
    rows = all_rows.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "key")
    classes = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = scratch.table(classes.join(comps, classes.key == comps.node, "left").select("key", "least", "copies", F.coalesce("root", "key").alias("root")), "pe-classes")
    roots = scratch.table(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "pe-roots")
    named = scratch.table(join_hot(classes.select("key", "copies", "root"), roots, "root", "members").select("key", "copies", "component_id"), "pe-named")
    out = join_hot(rows, named, "key", "copies").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(all_rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id. Rows with the empty set or a null doc_id stay."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    gone = components(docs, size, percent, scratch).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = scratch.table(gone, "pe-gone")
    plain, at = positional(docs)
    left = plain.join(gone, plain[at["doc_id"]] == gone["gone"], "left_anti")
    return left.toDF(*docs.columns)
