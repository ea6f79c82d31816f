"""Quality rules: learned decision lists.

Text statistics are counted for every whole text. Sequential covering then grows
conjunctions of thresholds on a part of the labelled rows and prunes them on the
rest; the ordered list becomes one Spark conditional expression.

Cases: a null text has no words, so it fails the base rule; an empty table gives an
empty result; without labels of both kinds the list is empty and only the base rule
decides; repeated rows are judged each on its own; a null doc_id is judged but never
learned from; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick, positional, prepare

#: At most so many labelled rows are learned from: those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_distinct"]
#: Rule features: a name, and numerator and denominator among the counts.
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_rate": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of `window` words that the text has twice or more. Exact: windows get ranks by doubling."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    rank, width = ids, 1
    while width < window:
        step = min(width, window - width)
        pair = rank[: len(rank) - step] * (n + 1) + rank[step:]
        order = np.argsort(pair, kind="stable")
        first = np.empty(len(pair), bool)
        first[:1] = True
        first[1:] = pair[order][1:] != pair[order][:-1]
        if first.all():
            return 0
        rank = np.empty(len(pair), np.int64)
        rank[order] = np.cumsum(first) - 1
        width += step
    many = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(many)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text."""
    raw = (text or "").encode()
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = int(by[9:14].sum() + by[32])
    return (
        len(words),
        len(raw) - int(by[128:192].sum()) - spaces,
        int(sum(by[c] for c in b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(by[65:91].sum()),
        int(by[65:91].sum() + by[97:123].sum()),
        int(by[33] + by[63]),
        int(by[48:58].sum()),
        len(set(words)),
    )


def count_texts(df: DataFrame, text: str) -> DataFrame:
    """All columns of df, then COUNTS of its text column."""
    kept = df.schema
    schema = kept.jsonValue()
    from pyspark.sql import types as T

    out = T.StructType.fromJson(schema)
    for c in COUNTS:
        out = out.add(c, T.LongType())
    names = [f.name for f in kept.fields]

    def run(b: pa.RecordBatch):
        rows = [statistics(t) for t in b.column(names.index(text)).to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.int64()) for c in cols]], names=[*names, *COUNTS])

    return arrow_map(df, run, out)


@dataclass(frozen=True)
class Rule:
    """Rejects what meets every (feature, is_above, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, above, t in self.tests:
            out &= x[f] > t if above else x[f] <= t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.tests:
            a, b = RATIOS[f]
            value = F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
            out = out & (value > F.lit(t) if above else value <= F.lit(t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if a else '<='} {t:.4g}" for f, a, t in self.tests)


def _grow(x, bad, live, cuts, max_tests):
    covered, tests = live.copy(), []
    while len(tests) < max_tests and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        best, best_gain = None, 1e-9
        for f, at in cuts.items():
            for t in at:
                for above in (True, False):
                    hit = covered & (x[f] > t if above else x[f] <= t)
                    p = (hit & bad).sum()
                    if p < 5:
                        continue
                    gain = p * (np.log2(p / hit.sum()) - np.log2(p0 / (p0 + n0)))
                    if gain > best_gain + 1e-9:
                        best, best_gain, kept = (f, above, float(t)), gain, hit
        if best is None:
            break
        tests.append(best)
        covered = kept
    return tests


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, max_rules: int = 16, max_tests: int = 4) -> list[Rule]:
    """Sequential covering of the bad rows. Every third row prunes and judges a rule, the others grow it; a rule must reach `precision` on both."""
    n = len(bad)
    if not n or bad.all() or not bad.any():
        return []
    judge = np.arange(n) % 3 == 2
    live, rules = np.ones(n, bool), []
    cuts = {f: np.unique(np.quantile(v[bad], np.linspace(0.0, 1.0, 25)[1:-1]).tolist() + np.quantile(v[~bad], [0.0, 0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999, 1.0]).tolist()) for f, v in x.items()}

    def value(tests, part):
        hit = Rule(tuple(tests)).covers(x) & live & part
        p, q = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - q) / (p + q) if p + q else -1.0, p, q

    while len(rules) < max_rules and (live & bad & ~judge).sum() >= 5:
        tests = _grow(x, bad, live & ~judge, cuts, max_tests)
        if not tests:
            break
        while len(tests) > 1 and value(tests[:-1], judge)[0] >= value(tests, judge)[0]:
            tests.pop()
        _, p, q = value(tests, judge)
        _, gp, gq = value(tests, ~judge)
        if p < 3 or p < precision * (p + q) or gp < precision * (gp + gq):
            break
        rules.append(Rule(tuple(tests)))
        live &= ~rules[-1].covers(x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from a bounded sample of labelled rows; ids and labels are collected for it, never texts. A doc_id with several labels counts as bad if any says so."""
    by_id = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = sample.collect()
    if len({r.quality for r in rows}) < 2:
        return []
    spark = prepare(docs.sparkSession)
    known = spark.createDataFrame([(r.doc_id, r.quality) for r in rows], "id long, quality int")
    narrow = pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "id").join(F.broadcast(known), "id").dropDuplicates(["id"])
    got = count_texts(narrow.select("id", "quality", "text"), "text").select("id", "quality", *COUNTS).limit(max_labelled).collect()
    if not got:
        return []
    got.sort(key=lambda r: (r.id * 0x9E3779B97F4A7C15) % (1 << 64))
    c = {k: np.array([r[k] for r in got], float) for k in COUNTS}
    x = {f: c[a] / np.maximum(c[b], 1) for f, (a, b) in RATIOS.items()}
    return learn_rules(x, np.array([r.quality == 0 for r in got]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def kept(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the base rule, then each learned rule, else keep."""
    out = F.when(base_failed(), F.lit(False))
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def assess(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, kept."""
    prepare(docs.sparkSession)
    got = count_texts(pick(docs, "doc_id", "text"), "text")
    return got.select("doc_id", *COUNTS, base_failed().alias("base_failed"), kept(rules).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows whose verdict is to keep them, with all their columns."""
    prepare(docs.sparkSession)
    plain, at = positional(docs)
    got = count_texts(plain, at["text"]).where(kept(rules))
    return got.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
