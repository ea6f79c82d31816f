"""License scans by diagonal voting.

All rolling word k-gram hashes of every text are joined with the positions of the same
k-grams in license templates. Hits vote for the diagonal (text position minus template
position) they lie on; neighbouring diagonals are merged into spans, so a few inserted
or lost words don't part a match; a span is verified by the share of the template's
k-grams that it holds, and by the words that tell the license from its neighbours (version,
sharealike, ...), which must stand there as they are. Short phrases are templates that must be held whole, on one diagonal.

Templates are a fixed, small set, so their positions are broadcast. Before the join, a
bitmap of the template hashes lets pass only k-grams that can join.

Cases: a null text counts as empty; no words, no labels; an empty table gives an empty
result; ties and repeated rows: one row per input row, labels distinct and sorted; a null
doc_id passes through; a word of any length is one word; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, lower_ascii, pick, prepare

#: Words: ASCII letters and digits, and all of beyond ASCII.
_NOT_WORD = bytes(32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))
_SPLIT = re.compile(rb" +")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What license texts and notices say, with the label of each.
NOTICES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-1.1": "Licensed under the Apache License, Version 1.1",
    "gpl-2.0": "licensed under the GNU General Public License, version 2",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-text": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
    "cc-by-sa-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "proprietary": "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited",
}
#: What tells a notice from those of other licenses or versions: phrases of at most NOTICE_K words, each of which must be within a k-gram that the text holds.
TELLING = {
    "apache-1.1": ["version 1 1"],
    "apache-2.0": ["version 2 0"],
    "gpl-2.0": ["gnu general public license", "version 2"],
    "gpl-3.0": ["gnu general public license", "version 3"],
    "gpl-text": ["gnu general public license"],
    "lgpl-text": ["gnu lesser general public"],
    "mpl-2.0": ["mozilla public license", "v 2 0"],
    "isc-text": ["copyright notice and this"],
    "cc-by-3.0": ["attribution 3 0"],
    "cc-by-4.0": ["attribution 4 0"],
    "cc-by-sa-3.0": ["attribution sharealike 3 0"],
    "cc-by-sa-4.0": ["attribution sharealike 4 0"],
    "cc-by-nc-4.0": ["attribution noncommercial 4 0"],
    "cc-by-nc": ["by nc 4 0"],
}
#: k of phrases that must be whole, and of notices; how far merged diagonals lie apart; the share of a notice's k-grams that a span must hold.
PHRASE_K, NOTICE_K, DRIFT, SHARE = 2, 4, 3, 0.6


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[bytes, ...]
    k: int
    whole: bool
    telling: tuple[tuple[bytes, ...], ...] = ()

    @property
    def grams(self) -> int:
        return len(self.words) - self.k + 1

    def covers(self) -> list[set[int]]:
        """Per telling phrase, the k-grams that hold it whole."""
        held = lambda i, p: any(self.words[j : j + len(p)] == p for j in range(i, i + self.k - len(p) + 1))
        return [{i for i in range(self.grams) if held(i, p)} for p in self.telling]


def words_of(text: str) -> list[bytes]:
    return lower_ascii(text.encode()).translate(_NOT_WORD).split()


def templates(phrases: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> list[Template]:
    out = []
    for text, label in phrases.items():
        out.append(Template(len(out), label, tuple(words_of(text)), PHRASE_K, True))
    for label, text in notices.items():
        out.append(Template(len(out), label, tuple(words_of(text)), NOTICE_K, False, tuple(tuple(words_of(p)) for p in TELLING.get(label, ()))))
    if any(t.grams < 1 for t in out):
        raise ValueError("a template is shorter than its k-grams")
    if not all(c for t in out for c in t.covers()):
        raise ValueError("a telling phrase isn't in its template")
    return out


class Hasher:
    """64-bit hashes of words, kept within a bound, and of their k-grams."""

    def __init__(self, most: int = 250_000):
        self.known, self.most = {}, most

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array(list(map(known.__getitem__, words)), np.uint64)


def grams_of(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def positions(known: list[Template]) -> list[tuple[int, int, int, int]]:
    """(hash, k, template, position) of all k-grams of the templates."""
    h = Hasher()
    return [(int(g.astype(np.int64)), t.k, t.number, i) for t in known for i, g in enumerate(grams_of(h.words(list(t.words)), t.k))]


def rolling_hits(docs: DataFrame, known: list[Template]) -> DataFrame:
    """row, doc_id, n_words and the k-grams (hash, position) of each text that pass the templates' bitmap."""
    wanted = {k: np.array(sorted({g for g, kk, _, _ in positions(known) if kk == k}), np.int64).astype(np.uint64) for k in {t.k for t in known}}
    rows = pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    state: dict = {}

    def run(b: pa.RecordBatch):
        if not state:
            state["hash"] = Hasher()
            for k, g in wanted.items():
                bits = np.zeros(1 << 16, bool)
                bits[(g & np.uint64(0xFFFF)).astype(np.int64)] = True
                state[k] = bits
        n, hits = [], []
        for t in b.column("text").to_pylist():
            words = words_of(t) if t else []
            h = state["hash"].words(words)
            n.append(len(words))
            got = []
            for k in wanted:
                g = grams_of(h, k)
                at = np.flatnonzero(state[k][(g & np.uint64(0xFFFF)).astype(np.int64)])
                got += [{"gram": x, "k": k, "at": a} for x, a in zip(g[at].astype(np.int64).tolist(), at.tolist())]
            hits.append(got)
        kind = pa.list_(pa.struct([("gram", pa.int64()), ("k", pa.int32()), ("at", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, kind)], names=["row", "doc_id", "n_words", "hits"])

    return arrow_map(rows, run, "row long, doc_id long, n_words long, hits array<struct<gram:bigint,k:int,at:bigint>>")


def scan(docs: DataFrame, known: list[Template] | None = None, drift: int = DRIFT, share: float = SHARE) -> DataFrame:
    """One row per document: row, doc_id, n_words, and its verified spans (label, whole, first and last word, share of the template)."""
    spark = prepare(docs.sparkSession)
    known = known or templates()
    table = F.broadcast(spark.createDataFrame(positions(known), "gram long, k int, template int, tpos int"))
    info = F.broadcast(spark.createDataFrame([(t.number, t.label, t.whole, t.grams, t.k) for t in known], "template int, label string, whole boolean, grams int, size int"))
    hits = rolling_hits(docs, known).select("row", "doc_id", "n_words", F.explode_outer("hits").alias("h")).select("row", "doc_id", "n_words", F.col("h.gram").alias("gram"), F.col("h.k").alias("k"), F.col("h.at").alias("at"))
    joined = hits.join(table, ["gram", "k"], "left").join(info, "template", "left")
    votes = joined.groupBy("row", "doc_id", "n_words", "template", "label", "whole", "grams", "size", (F.col("at") - F.col("tpos")).alias("diagonal"), (F.when(~F.col("whole"), F.floor(F.col("at") / (F.lit(4) * F.col("grams"))))).alias("zone")).agg(F.count("at").alias("votes"), F.min("at").alias("a"), F.max("at").alias("b"), F.collect_set("tpos").alias("held"))
    # Whole phrases: a diagonal that holds all k-grams is a match by itself. Notices: diagonals at most `drift` apart, next to each other in the text, are one span.
    per = votes.groupBy("row", "doc_id", "n_words").agg(F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "a", "b", "held", "label", "whole", "grams", "size"))).alias("v"))
    kind = pa.list_(pa.struct([("label", pa.string()), ("whole", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))

    telling = {t.number: t.covers() for t in known}

    def run(b: pa.RecordBatch):
        out = [merge(v, drift, share, telling) for v in b.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n_words"), pa.array([[dict(zip(("label", "whole", "first", "last", "share"), s)) for s in x] for x in out], kind)], names=["row", "doc_id", "n_words", "found"])

    return arrow_map(per, run, "row long, doc_id long, n_words long, found array<struct<label:string,whole:boolean,first:bigint,last:bigint,share:double>>")


def merge(votes: list[dict], drift: int, share: float, telling: dict[int, list[set[int]]]) -> list[tuple[str, bool, int, int, float]]:
    """Verified spans (label, whole, first word, last word, share of the template) from the diagonals of one text."""
    out = []
    by: dict[int, list[dict]] = {}
    for v in votes:
        by.setdefault(v["template"], []).append(v)
    for vs in by.values():
        v0 = vs[0]
        if v0["whole"]:
            out += [(v["label"], True, v["diagonal"], v["diagonal"] + v["grams"] + v["size"] - 2, 1.0) for v in vs if len(v["held"]) == v["grams"]]
            continue
        spans: list[dict] = []
        for v in sorted(vs, key=lambda v: (v["a"], v["diagonal"])):
            # Of all spans that are still open here, the one on the nearest diagonal takes it in; stray hits on other diagonals are spans of their own.
            near = [s for s in spans if abs(v["diagonal"] - s["diagonal"]) <= drift and v["a"] <= s["start"] + 2 * v["grams"]]
            if near:
                span = min(near, key=lambda s: abs(v["diagonal"] - s["diagonal"]))
                span["held"] |= set(v["held"])
                span["b"], span["diagonal"] = max(span["b"], v["b"]), v["diagonal"]
            else:
                spans.append({"diagonal": v["diagonal"], "start": v["a"], "a": v["a"], "b": v["b"], "held": set(v["held"])})
        for s in spans:
            part = len(s["held"]) / v0["grams"]
            if part >= share and all(c & s["held"] for c in telling[v0["template"]]):
                out.append((v0["label"], False, s["a"], s["b"] + v0["size"] - 1, part))
    return sorted(out, key=lambda s: (s[2], s[3], s[0]))


def summary(found: DataFrame) -> DataFrame:
    """Per document: counts and bounds of the base phrases, base_labels, labels and a score: the largest share of a template found."""
    base = F.filter("found", lambda s: s["whole"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )

