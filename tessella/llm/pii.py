"""Personal data: patterns, and terms that disclose what the patterns found.

Patterns find the protected entities (mail and network addresses, card and phone
numbers). For each term of a document that holds an entity, the corpus tells how strongly
the term reveals the entity: their pointwise mutual information, as a share of the entity's
own information content. Terms over the threshold are generalised, far over it removed,
wherever they stand in documents that hold the entity.

Pairs, terms, entities and the total all count documents (copies too), and a pair needs
`min_support` of them. Terms are told apart by 64-bit hashes.

Cases: a null text counts as empty and has no spans; an empty table gives an empty
result; repeated rows give one row each (each counts as a document); null doc_ids pass through; other columns are ignored by detect() and kept by
sanitise(). Of spans that overlap, the one that starts first (then the longer) replaces.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_map, bitmap, lean, pick, positional, prepare

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NO_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start within a run of digits fails as the run's own start did, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG = re.compile(r"[0-9][0-9\x20-]{14}")
_TERM = re.compile(r"[^\W\d_]{3,}")
#: Up to so many terms, tasks get their hashes and count nothing else; of more, a bitmap of so many bits.
EXACT, BITS = 1 << 19, 1 << 26


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > last and not _NO_LOCAL.match(text, a - 1):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start: leftmost matches of each kind that pass its test."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text) if _LONG.search(text) else ():
        d = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def entity(kind: str, value: str) -> int:
    value = value.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value)
    return _signed(xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode()))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


_TERMS = "array<struct<term:bigint,start:int,end:int>>"
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def terms_of(text: str, spans: list[tuple[str, int, int]], known: dict[str, int]) -> list[tuple[int, int, int]]:
    """(hash, start, end) of every term that overlaps no span; `known` keeps hashes of words."""
    out, k = [], 0
    edges = sorted((a, b) for _, a, b in spans)
    reach = 0
    for m in _TERM.finditer(text):
        x, y = m.span()
        while k < len(edges) and edges[k][0] < y:
            reach = max(reach, edges[k][1])
            k += 1
        if x >= reach:
            w = m.group()
            h = known.get(w)
            if h is None:
                if len(known) > 200_000:
                    known.clear()
                h = known[w] = _hash_of([w.lower()])[0]
            out.append((h, x, y))
    return out


def _scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, spans, the entities of each document and, where there are some, its terms."""
    rows = pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()).withColumn("text_hash", F.xxhash64("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(b: pa.RecordBatch):
        known: dict[str, int] = {}
        spans, terms, sizes, entities = [], [], [0], []
        for t in b.column("text").to_pylist():
            got = find(t) if t else []
            spans.append([{"kind": k, "start": x, "end": y} for k, x, y in got])
            if got:
                terms.append(np.array(terms_of(t, got, known), np.int64).reshape(-1, 3))
            sizes.append(sizes[-1] + (len(terms[-1]) if got else 0))
            entities.append(list({entity(k, t[x:y]) for k, x, y in got}))
        flat = np.concatenate(terms) if terms else np.zeros((0, 3), np.int64)
        held = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2].astype(np.int32))], names=["term", "start", "end"])
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("text_hash"), pa.array(spans, span), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), held), pa.array(entities, pa.list_(pa.int64()))], names=["row", "doc_id", "text_hash", "spans", "terms", "entities"])

    return arrow_map(rows, run, f"row long, doc_id long, text_hash long, spans {_SPANS}, terms {_TERMS}, entities array<bigint>")


def _hash_of(terms: list[str]) -> list[int]:
    """Spark's xxhash64 of strings."""
    return [_signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in terms]


def _partial_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, n: each task's own counts of documents that hold a wanted term, one row per term and task (and per 200,000 terms counted); past EXACT terms, some unwanted ones too."""
    exact = wanted.count() <= EXACT
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas()["term"].to_numpy(np.int64)) if exact else bitmap(wanted, "term", BITS))

    def run(batches):
        table = sent.value
        count: dict[int, int] = {}
        passes: dict[str, int | None] = {}

        low = bytearray(1 << 20)  # most terms aren't wanted, and their last 20 bits tell
        if exact:
            np.frombuffer(low, np.uint8)[table & 0xFFFFF] = 1

        def held(h):
            if not exact:
                return table[(h & (BITS - 1)) >> 3] >> (h & 7) & 1
            if not low[h & 0xFFFFF]:
                return False
            at = np.searchsorted(table, h)
            return at < len(table) and table[at] == h

        def out():
            r = pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], names=["term", "n"])
            count.clear()
            return r

        for b in batches:
            for t in b.column("text").to_pylist():
                for w in {w.lower() for w in set(_TERM.findall(t))} if t else ():
                    h = passes.get(w, 0)
                    if h == 0:
                        if len(passes) > 400_000:
                            passes.clear()
                        h = _hash_of([w])[0]
                        h = passes[w] = h if held(h) else None
                    if h is not None:
                        count[h] = count.get(h, 0) + 1
                if len(count) > 200_000:
                    yield out()
        yield out()

    return pick(docs, "text").mapInArrow(lean(run), "term long, n long")


def _document_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """term and the number of documents that hold it, for the wanted terms: the tasks' counts are added up and joined exactly."""
    return _partial_counts(docs, wanted).groupBy("term").agg(F.sum("n").alias("n_term")).join(wanted, "term", "left_semi")


def _shared(scanned: DataFrame, min_support: int) -> DataFrame:
    """entity, n_entity: of the entities that min_support documents hold; no other can have a pair with that support."""
    return scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= min_support)


def disclosures(docs: DataFrame, scanned: DataFrame, scratch: Scratch, min_support: int = 3, threshold: float = 0.5) -> DataFrame:
    """entity, term (its hash) and disclosure (PMI as a share of the entity's information content) of the pairs over the threshold."""
    by_entity = _shared(scanned, min_support)
    held = scanned.select(F.explode("entities").alias("entity"), F.array_distinct("terms.term").alias("terms")).join(by_entity.select("entity"), "entity", "left_semi")
    pairs = scratch.table(held.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_support), "pii-pairs")
    total = max(1, scanned.count())
    counts = _document_counts(docs, pairs.select("term").distinct())
    d = F.lit(float(total))
    pmi = F.log2(F.col("n_both") * d / (F.col("n_term") * F.col("n_entity")))
    content = F.log2(d / F.col("n_entity"))
    joined = pairs.join(by_entity, "entity").join(counts, "term").withColumn("disclosure", F.when(content > 0, F.least(F.lit(1.0), pmi / content)).otherwise(0.0))
    return joined.where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def detect(docs: DataFrame, scratch: Scratch | None = None, min_support: int = 3, threshold: float = 0.5, removal: float = 0.8) -> DataFrame:
    """One row per document: row, doc_id, text_hash, spans (kind, start, end), sorted by kind as listed, then start; `term` and `removed` spans come last."""
    spark = prepare(docs.sparkSession)
    scratch = scratch or Scratch(spark)
    scanned = scratch.table(_scan(docs), "pii-scan")
    risky = scratch.table(disclosures(docs, scanned, scratch, min_support, threshold), "pii-risky")
    # Per document, the terms that one of its entities makes risky; then every place of those.
    held = scanned.select("row", F.explode("entities").alias("entity"), F.array_distinct("terms.term").alias("terms")).join(risky.select("entity").distinct(), "entity", "left_semi")
    told = held.select("row", "entity", F.explode("terms").alias("term")).join(risky, ["entity", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("d"))
    places = scanned.select("row", F.explode("terms").alias("x")).select("row", "x.term", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))
    extra = places.join(told, ["row", "term"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("d") >= removal, "removed").otherwise("term").alias("kind"), "start", "end"))).alias("more"))
    extra = scratch.table(extra, "pii-extra")
    return scanned.join(extra, "row", "left").select("row", "doc_id", "text_hash", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans"))


PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}


def replace(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans replaced; overlapping spans are replaced as one, by the first's placeholder."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], PLACEHOLDER[kind]]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, scratch: Scratch | None = None, text_length: str | None = None, **options) -> DataFrame:
    """All rows and columns, with `text` sanitised, and the column named `text_length`, if given, its new length.

    Pattern spans are found again where the text is; only rows with term spans are joined, so most texts never move if those are few.
    """
    spark = prepare(docs.sparkSession)
    scratch = scratch or Scratch(spark)
    found = detect(docs, scratch, **options)
    terms = scratch.table(found.select("text_hash", F.filter("spans", lambda s: s["kind"].isin("term", "removed")).alias("more")).where(F.size("more") > 0).dropDuplicates(["text_hash"]), "pii-terms")
    plain, at = positional(docs)
    names, text, length = plain.columns, at["text"], at.get(text_length) if text_length else None
    joined = plain.withColumn("text_hash", F.xxhash64(text)).join(terms, "text_hash", "left")

    def run(b: pa.RecordBatch):
        cols = {n: b.column(n) for n in names}
        new = [None if t is None else replace(t, find(t) + [(m["kind"], m["start"], m["end"]) for m in more or ()]) for t, more in zip(cols[text].to_pylist(), b.column("more").to_pylist())]
        cols[text] = pa.array(new, cols[text].type)
        if length:
            cols[length] = pa.array([None if t is None else len(t) for t in new], cols[length].type)
        yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return arrow_map(joined, run, T.StructType(plain.schema.fields)).toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count per kind, base_sha256 and the spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
