"""The operators against brute force, on small tables with odd cases."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, bpe_reuse, jaccard_join, language_id, license_scan, lm_kernel, lm_score, nearest, packing, pii, quality_rules, token_file
from tessella.llm.common import Scratch, lower_ascii

BASE = "the cat sat on the mat and looked at the small grey mouse that ran over the old wooden floor of the quiet house today"
TEXTS = [
    None, "", "   \n\t ", "one", BASE, BASE, BASE.replace("mouse", "bird"), BASE.upper() + " indeed", "a b c d e f g h " * 6,
    "Released under the MIT License. Apache License; CC BY 4.0 and the GNU General Public License gnu general public license",
    "mail a.b@mail7.example.com or x@y, call +1 (269) 555-3296, card 4539 1488 0343 6467, ip 10.0.0.255 and 10.0.0.256 é́ 中文",
    "<|endoftext|> a|b |> it's <|STARTOFTEXT|> ΟΔΟΣ İstanbul \x1c \x85 end  ", "line one is here\nline one is here\n\nother", "x" * 30000, "der die das und ist nicht mit auf eine " * 20,
]
DOCS = [(i, t, "de" if t and t.startswith("der") else "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(4, BASE, "en", "s", 3), (None, BASE, None, None, None), (-7, "short text", "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as n_words", "'x' as TEXT_", "2 as kept", "3 as `Doc_Id`").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_quality_statistics():
    for t in TEXTS:
        w = split(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        got = quality_rules.statistics(t)
        assert got[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


def test_quality_rules(spark, docs, empty):
    rng = np.random.default_rng(1)
    x = {f: rng.random(900) for f in quality_rules.RATIOS}
    bad = (x["symbol_share"] > 0.7) | (x["upper_share"] > 0.9)
    rules = quality_rules.learn_rules(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert (hit & bad).sum() > 0.8 * bad.sum() and (hit & ~bad).sum() <= 0.05 * bad.sum()
    assert quality_rules.assess(docs, rules).count() == len(DOCS) and quality_rules.assess(empty, rules).count() == 0
    kept = quality_rules.keep_good(docs, [])
    assert kept.columns == docs.columns and kept.count() == sum(len(split(d[1])) >= 20 and 100 * quality_rules.statistics(d[1])[4] <= 30 * len(split(d[1])) for d in DOCS)
    labels = spark.createDataFrame([(None, 1), (4, None)], "doc_id long, quality int")
    assert quality_rules.fit(docs, labels) == []


def test_language(docs, empty):
    model = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert language_id.predict(empty, language_id.learn(empty)).count() == 0
    assert rows(language_id.predict(docs, language_id.Model(())), "lang_pred") == [["und"]] * len(DOCS)
    assert language_id.keep_known(docs, model).columns == docs.columns


def test_cross_parsing_is_longest_match():
    rng = np.random.default_rng(3)
    sample = "".join(rng.choice(list("abc "), 400))
    p = language_id.Parser(language_id.Model((("x", sample),)))
    assert p.langs == ["x"]
    for n in (1, 17, 255, 256, 257, 5000):
        t = "".join(rng.choice(list("abc "), n))
        count, at = 0, 0
        while at < n:
            k = 1
            while at + k <= n and t[at : at + k] in sample:
                k += 1
            at += max(k - 1, 1)
            count += 1
        assert p.phrases([t])[0, 0] == count


def test_parse_of_long_texts_with_rare_and_many_symbols():
    rng = np.random.default_rng(13)
    for letters in ("ab", "".join(map(chr, range(0x4E00, 0x4E00 + 200)))):
        sample = "".join(rng.choice(list(letters), 3000)) + (letters[0] * 700)
        texts = [letters[0] * 2000, "".join(rng.choice(list(letters + "?"), 3000)), "?" * 600, letters[0] * 255 + "?" + letters[1] * 900]
        p = language_id.Parser(language_id.Model((("x", sample),)))
        for t, got in zip(texts, p.phrases(texts)[:, 0].tolist()):
            count, at = 0, 0
            while at < len(t):
                k = 1
                while at + k <= len(t) and t[at : at + k] in sample:
                    k += 1
                at += max(k - 1, 1)
                count += 1
            assert got == count


def test_only_letters_make_a_language_and_sample_lengths_count():
    model = language_id.Model((("a", "the cat and the dog " * 9), ("b", "der hund und die katze " * 30)))
    assert [g[0] for g in language_id.judge(["½ ² ٣ 12", "the dog", "die katze", None], model)] == ["und", "a", "b", "und"]
    p = language_id.Parser(model)
    assert p.weight[0] < p.weight[1]


def test_languages_of_many_scripts_and_long_documents(spark):
    rng = np.random.default_rng(8)
    scripts = {"ar": range(0x627, 0x64B), "el": range(0x3B1, 0x3CA), "en": range(97, 123), "hi": range(0x905, 0x93A), "ko": range(0xAC00, 0xAC00 + 28 * 20, 28), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x4E00 + 900)}
    words = {k: ["".join(chr(c) for c in rng.choice(list(v), 2 if k == "zh" else 5)) for _ in range(500)] for k, v in scripts.items()}
    make = lambda k, n: ("" if k == "zh" else " ").join(rng.choice(words[k], n))
    data = [(100 * j + i, make(k, 3000 if k == "el" else 150), k) for j, k in enumerate(scripts) for i in range(40)]
    df = spark.createDataFrame([*data, (9999, "".join(map(chr, range(0x10A0, 0x10C5))) * 9, "xx")], "doc_id long, text string, lang string")
    model = language_id.learn(df.where("lang <> 'xx'"))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()}
    assert [i for i, _, k in data if got[i] != k] == []
    assert {r.doc_id for r in language_id.keep_known(df, model).collect()} == {i for i, _, _ in data}


def test_bpe_is_the_librarys(docs, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d in DOCS:
        ids = tok.encode(d[1] or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.append([d[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()])
    assert rows(bpe_reuse.code_documents(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe_reuse.code_documents(empty).count() == 0


def test_bpe_joins_are_repaired():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = bpe.load(path)
    rng = np.random.default_rng(4)
    texts = [t for t in TEXTS if t] + [" ".join(rng.choice(["don't", "naïve", "中文字", "a\n\n b", "<|endoftext|>", "x1y2", "...", "the", "\u2003wide", "  two"], 900))] * 2
    torn = 0
    for marks in (1 / 3, 1 / 40, 1 / 256):
        c = bpe_reuse.ChunkCoder(path, 4, marks)
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in c.encode_all([t.encode() for t in texts])] == want
        for t, ids in zip(texts, want):
            raw, at = t.encode(), bpe_reuse.cut_places(t.encode(), 4, marks).tolist()
            glued = [i for a, b in zip([0, *at], [*at, len(raw)]) for i in tok.encode(raw[a:b].decode(), add_special_tokens=False).ids]
            torn += glued != ids
            assert c.encode(t) == ids and c.decode(ids) == tok.decode(ids, skip_special_tokens=False)
        assert c.repaired and c.reused
    assert torn > 10  # without the repair, ids would be wrong


def test_bpe_windows_widen_until_the_sides_agree(monkeypatch):
    c = bpe_reuse.ChunkCoder(public_tokenizers.path("byte_bpe_50k.json"), 4, 1 / 40)
    text = "some ordinary words of a text that is cut within its words, and so on " * 30
    want = c.tok.encode(text, add_special_tokens=False).ids
    # Places that aren't safe (within words) make first windows disagree.
    monkeypatch.setattr(bpe_reuse, "safe_places", lambda raw: np.arange(0, len(raw) + 1, 3) if len(raw) % 3 == 0 else np.append(np.arange(0, len(raw), 3), len(raw)))
    got = c.encode(text)
    assert c.widened and c.decode(got) == c.decode(want)


def test_ranks_give_the_librarys_ids():
    """In every plane that has characters, each code point after and before letters, digits, punctuation and spaces; runs; random mixtures."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, c = bpe.load(path), bpe_reuse.ChunkCoder(path)
    assert c.ranked is not None and bpe.ranked(public_tokenizers.path("word_bpe_49k.json")) is None
    rng = np.random.default_rng(8)
    parts = ["a%sb 1%s2 %s%s.%s!" % ((chr(i),) * 5) for i in [*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)]]
    parts += [x * n for x in (" ", "\n", "a", "1", "'s", "é", "中", "\u2003 ") for n in (1, 2, 100, 2000, 40_000)]
    some = [" ", "  ", "\n", "'ll", "'S", "don't", "ab", "12", "é", "中文", "...", "\x85", "\xa0", "<|endoftext|>", "🙂", "a\u0301"]
    parts += ["".join(rng.choice(some, 60)) for _ in range(3000)]
    for a in range(0, len(parts), 20_000):
        want = tok.encode_batch_fast(parts[a : a + 20_000], add_special_tokens=False)
        assert [np.frombuffer(x, c.kind).tolist() for x in c._fresh([p.encode() for p in parts[a : a + 20_000]])] == [e.ids for e in want]


def word_ids(t, end):
    tok = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    return tok.encode(t or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file(spark, docs, empty):
    path = Scratch(spark).path("tokens")
    token_file.write(docs, path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file.read(spark, path).collect())
    at, want = 0, []
    for d in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = word_ids(d[1], 2)
        want.append((at, d[0], len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    path = Scratch(spark).path("tokens")
    token_file.write(empty, path)
    assert token_file.read(spark, path).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5, 9], list(range(0, 3000, 7)), [0, 1 << 40]])
def test_elias_fano(values):
    e, _ = token_file.EliasFano.load(token_file.EliasFano.of(np.array(values, np.uint64)).dump(), 0)
    assert e.all().tolist() == values == [e.select(i) for i in range(len(values))]


def test_select_many_is_select():
    rng = np.random.default_rng(7)
    for n, step in ((1, 1), (300, 3), (3000, 5000), (2000, 1)):
        v = np.cumsum(rng.integers(0, step + 1, n)).astype(np.uint64)
        e = token_file.EliasFano.of(v)
        at = rng.integers(0, n, 50)
        assert e.select_many(np.arange(n)).tolist() == v.tolist() and [e.select(int(i)) for i in at] == e.select_many(at).tolist() == v[at].tolist()


def test_packing(docs, empty):
    got = packing.pack(docs, window=64).collect()
    by_doc, by_seq = Counter(), {}
    for r in got:
        by_doc[r.doc_id] += r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = Counter()
    for d in DOCS:
        want[d[0]] += len(word_ids(d[1], 1))
    assert by_doc == want
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty).count() == 0
    lengths = np.random.default_rng(2).integers(1, 65, 500).tolist()
    place, _, used = packing.best_fit_decreasing(lengths, 64)
    assert used <= 1.03 * sum(lengths) / 64 + 1 and max(np.bincount(place, lengths)) <= 64


def brute_spans(t):
    email = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ip = [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    card = [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    phone = [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]
    return email + ip + card + phone


def test_pii_spans(docs, empty):
    rng = np.random.default_rng(5)
    for t in [x or "" for x in TEXTS] + ["".join(rng.choice(list("a1.@+-( 4"), 200)) for _ in range(300)]:
        assert pii.find(t) == brute_spans(t)
    got = pii.digest(pii.detect(docs))
    want = sorted(([d[0], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(d[1] or "")).encode()).hexdigest()] for d in DOCS), key=repr)
    assert rows(got, "doc_id", "base_sha256") == want
    clean = pii.sanitise(docs, text_length="n_chars")
    assert clean.columns == docs.columns and clean.count() == len(DOCS)
    assert not [r for r in clean.collect() if r.text and "@mail7" in r.text]
    assert pii.detect(empty).count() == 0


def test_disclosing_terms(spark):
    told = [(i, f"note {i} w{chr(97 + i)}x please ask zorblatt at q{0}@host.example.com for the file {chr(97 + i) * 4}") for i in range(6)]
    other = [(100 + i, f"please ask for the file and note number {i}") for i in range(60)]
    df = spark.createDataFrame(told + other, "doc_id long, text string")
    text = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("zorblatt" not in text[i] and "please" in text[i] for i in range(6)) and text[100] == other[0][1]


def test_disclosing_terms_of_copied_passages(spark):
    line = "zorblatt answers at q0@host.example.com on weekdays"
    told = [(i, f"{chr(97 + i) * 5} {line}") for i in range(5)] + [(10 + i, f"{line} again") for i in range(40)]
    copied = [(60 + i, "quimby reads r7@host.example.com only") for i in range(30)]
    other = [(100 + i, f"answers and reads again on weekdays only {i}") for i in range(900)]
    text = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(told + copied + other, "doc_id long, text string")).collect()}
    assert not [i for i, _ in told if "zorblatt" in text[i]] and not [i for i, _ in copied if "quimby" in text[i]]
    assert all("answers" in text[i] and "weekdays" in text[i] for i, _ in told)


def test_disclosing_terms_anywhere_in_the_document(spark):
    told = [(i, f"Zorblatt wrote this\nplease ask for the file and note number {i} by mail to q0@host.example.com\nyours zorblatt") for i in range(6)]
    other = [(100 + i, f"this wrote yours please ask for the file and note number by mail {i}") for i in range(60)]
    text = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(told + other, "doc_id long, text string")).collect()}
    assert all("zorblatt" not in text[i].lower() and "please" in text[i] for i in range(6))


def test_tasks_count_the_wanted_terms_alone(spark, monkeypatch):
    words, low, wanted = ("".join(w) for w in itertools.product("abcdefghij", repeat=4)), {}, []
    for w in words:  # pairs whose hashes end in the same 20 bits
        h = pii._hash_of([w])[0]
        wanted += [(low[h & 0xFFFFF], w)] if h & 0xFFFFF in low else []
        low.setdefault(h & 0xFFFFF, w)
    df = spark.createDataFrame([(" ".join(x),) for x in wanted for _ in range(3)], "text string").repartition(2)
    want = spark.createDataFrame([(pii._hash_of([x[0]])[0],) for x in wanted], "term long")
    held = {r.term for r in want.collect()}
    assert wanted and {r.term for r in pii._partial_counts(df, want).collect()} == held
    for exact in (pii.EXACT, 0):  # as a bitmap, too, the joined counts are exact
        monkeypatch.setattr(pii, "EXACT", exact)
        assert {(r.term, r.n_term) for r in pii._document_counts(df, want).collect()} == {(h, 3) for h in held}
    assert pii._document_counts(df, want.limit(0)).count() == 0


def brute_components(data):
    sets = []
    for _, t in data:
        w = split(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(data)))
    for _ in range(len(data)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((d for (d, _), x in zip(data, root) if x == r and d is not None), default=None) for r in root}
    return sorted(([d, len(s), least[r] if s else d] for (d, _), s, r in zip(data, sets, root)), key=repr)


def test_jaccard_join(spark, docs, empty):
    assert rows(jaccard_join.components(docs), "doc_id", "n_shingles", "component_id") == brute_components([(d[0], d[1]) for d in DOCS])
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    data = []
    for g in range(12):
        base = rng.choice(words, rng.integers(3, 90)).tolist()
        for _ in range(6):
            w = [x if rng.random() > 0.02 * (g % 3) else "edit" + str(rng.integers(1000)) for x in base]
            data.append((len(data), " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard_join.components(df), "doc_id", "n_shingles", "component_id") == brute_components(data)
    assert jaccard_join.components(empty).count() == 0
    kept = jaccard_join.keep_one(df)
    assert {r.doc_id for r in kept.collect()} == {r[2] for r in brute_components(data)}


def shingle_set(t):
    w = split(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_sets_hold_each_text_s_own_shingles(monkeypatch):
    odd = ["a\0 a\0\0 a b c", "a a a b c", "aaaaaaaa aaaaaaaaa aaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaa x", "z" * 32 + " " + "z" * 33 + " " + "z" * 34, "\x1c\x85 \u00a0 \u3000 \x08 \x0e", "end", "e nd", " lead", "trail\r\n", "b c d e f", None]
    texts = [*TEXTS, *odd, "", "", *TEXTS, ""]
    want = [shingle_set(t) for t in texts]
    for block in (1, 40, 1 << 18):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        for kind in (pa.string(), pa.large_string()):
            got = list(jaccard_join.sets_of(pa.array(["cut off", *texts, "too"], kind).slice(1, len(texts))))
            assert [len(s) for s in got] == [len(s) for s in want]
            for (a, x), (b, y) in itertools.combinations(zip(got, want), 2):
                assert len(np.intersect1d(a, b)) == len(x & y)
    assert list(jaccard_join.sets_of(pa.array([], pa.string()))) == [] == [s.size for s in jaccard_join.sets_of(pa.array([None, ""], pa.string())) if s.size]


def test_sets_take_less_than_half_the_time_of_hashing_word_by_word():
    rng = np.random.default_rng(3)
    known = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 10))) for _ in range(20_000)]
    texts = [" ".join(rng.choice(known, 400)) for _ in range(1000)]
    hasher, column = license_scan.Hasher(), pa.array(texts)

    def each():
        return [np.unique(license_scan.grams_of(hasher.words(lower_ascii(t.encode()).split()), 5)) for t in texts]

    def took(f):
        began = time.process_time()
        got = f()
        return time.process_time() - began, [len(s) for s in got]

    slow, fast = (min(took(f) for _ in range(3)) for f in (each, lambda: list(jaccard_join.sets_of(column))))
    assert slow[1] == fast[1] and fast[0] < slow[0] / 2


def test_similar_sets_share_a_signature_whatever_is_common():
    rng = np.random.default_rng(12)
    pe = jaccard_join.PartEnum()
    assert any((pe._of(np.sort(rng.integers(0, 2**64, 50, np.uint64)), j, 0, -1)[0].size % 3 == 0) for j in pe.bands(50))
    for n in [2, 3, 4, 5, 6, 7, 9, 12, 20, 33, 64, 100, 260, 900] * 6:
        r = np.unique(rng.integers(0, 2**64, n, np.uint64))
        gone = int(rng.integers(0, max(1, n // 9) + 1))
        new = max(0, (len(r) - gone) * 100 // 80 - len(r)) if rng.random() < 0.7 else 0
        s = np.unique(np.concatenate([r[rng.permutation(len(r))[gone:]], rng.integers(0, 2**64, new, np.uint64)]))
        both = len(np.intersect1d(r, s))
        if 100 * both < 80 * (len(r) + len(s) - both) or np.array_equal(r, s):
            continue
        common = set(rng.choice(np.union1d(r, s), int(rng.random() * len(np.union1d(r, s))), replace=False).tolist())
        mark = lambda x: np.array([v in common for v in x.tolist()], bool)
        assert np.intersect1d(pe.signatures(r, mark(r)), pe.signatures(s, mark(s))).size


def test_license_scan(docs, empty):
    got = {(r.doc_id): r for r in license_scan.summary(license_scan.scan(docs)).collect()}
    for d in DOCS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d[1]))
        at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[d[0]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.summary(license_scan.scan(empty)).count() == 0
    text = license_scan.NOTICES["mit-text"].replace("without restriction", "with no restriction")
    assert "mit-text" in {s[0] for s in [(x.label,) for x in license_scan.scan(docs.limit(1).selectExpr("1L as doc_id", f"'{text}' as text")).collect()[0].found]}


def test_a_stray_hit_between_the_halves_of_a_notice_does_not_part_it():
    held = lambda d, at: [{"template": 5, "label": "x", "whole": False, "grams": 20, "size": 4, "diagonal": d, "a": d + at[0], "b": d + at[-1], "held": at}]
    votes = held(100, list(range(10))) + held(101, list(range(11, 20)))
    for stray in ([], held(103 + 5, [5]), held(500, [0])):
        stray = [dict(v, a=109, b=109) for v in stray]
        assert [s[0] for s in license_scan.merge(votes + stray, 3, 0.6, {5: []})] == ["x"]


def test_license_versions_are_told_apart(spark):
    work = "This work is licensed under a Creative Commons Attribution"
    want = {
        "licensed under the GNU General Public License, version 2": "gpl,gpl-2.0", "licensed under the GNU General Public License, version 3": "gpl,gpl-3.0", "Licensed under the Apache License, Version 1.1": "apache,apache-1.1", "Licensed under the Apache License, Version 2.0": "apache,apache-2.0",
        f"{work} 3.0 Unported License": "cc-by-3.0", f"{work} 4.0 International License": "cc-by-4.0", f"{work}-ShareAlike 4.0 International License": "cc-by-sa-4.0", f"{work}-NonCommercial-ShareAlike 4.0 International License": "",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert [r.labels for r in license_scan.summary(license_scan.scan(df)).orderBy("doc_id").collect()] == list(want.values())


def test_lm_base_score(spark, docs, empty):
    scratch = Scratch(spark)
    got = lm_score.score_documents(docs, lm_score.fit(docs, scratch, head=5), scratch).collect()
    toks = [(d[0], [*split(lower(d[1])), None]) for d in DOCS]
    c = Counter(w for i, ws in toks if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in toks), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score <= 0 for r in got)
    assert lm_score.score_documents(empty, lm_score.fit(empty, scratch), scratch).count() == 0


def test_lm_is_a_distribution():
    """The probabilities of all ids after a start add up to one: for each class, its ids share its probability."""
    counts = np.ones(lm_score.VOCABULARY)
    m = lm_score.train([np.arange(50, dtype=np.uint16)], counts, np.zeros(lm_score.VOCABULARY, bool), steps=3)
    assert np.allclose(np.bincount(m.of_class, 10.0**m.share)[np.unique(m.of_class)], 1)
    long = np.random.default_rng(0).integers(0, 40000, 100).astype(np.uint16)
    assert np.isclose(lm_score.score(m, [long, long[:3]]).sum(), lm_score.score(m, [long])[0] + lm_score.score(m, [long[:3]])[0])


def test_lm_score_is_that_of_a_loop_over_single_ids():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, lm_score.VOCABULARY).astype(float)
    ids = [rng.integers(0, 300, n).astype(np.uint16) for n in (0, 1, 11, 12, 13, 40)]
    m = lm_score.train(ids, counts, rng.random(lm_score.VOCABULARY) < 0.5, steps=30)
    p, t = m.p, m.tables()
    want = []
    for x in ids:
        seen, total = [m.start], 0.0
        for i in [*x.tolist(), lm_score.END_ID]:
            near = np.array(seen[-lm_score.SPAN :])
            s = t["K"][near] @ t["Q"][seen[-1]] + p["r"][: len(near)][::-1]
            a = np.exp(s) / np.exp(s).sum()
            h = np.maximum(a @ t["V"][near] + t["R"][seen[-1]], 0)
            c = m.of_class[i]
            g, w = divmod(int(c), lm_score.GROUPS)
            for z, k in ((h @ p["U"] + p["b"], g), (h @ p["U2"][g] + p["b2"][g], w)):
                total += (z[k] - np.log(np.exp(z).sum())) / np.log(10)
            total += m.share[i]
            seen.append(m.symbol[i])
        want.append(total)
    assert np.allclose(lm_score.score(m, ids, 3), want, rtol=1e-4)


def test_lm_learns_from_a_share_of_the_corpus(spark, monkeypatch):
    scratch, rng = Scratch(spark), np.random.default_rng(6)
    words = ["red fox", "blue bird", "old house"]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words, 60))) for i in range(300)], "doc_id long, text string").repartition(5)
    w = spark.createDataFrame([(np.full(3, k, np.float32).tobytes(), k + 1) for k in range(5)], "w binary, n long")
    assert np.allclose(np.frombuffer(lm_score.average(w, scratch, 2), np.float32), sum(k * (k + 1) for k in range(5)) / 15)
    assert lm_score.average(w.limit(0), scratch) is None
    monkeypatch.setattr(lm_score, "STEPS", 40)
    sums = []
    for rounds in ((), ((1.0, 0.01), (1.0, 0.01))):
        monkeypatch.setattr(lm_score, "ROUNDS", rounds)
        got = lm_score.score_documents(df, lm_score.fit(df, scratch), scratch).collect()
        sums.append(sum(r.score for r in got if r.held_out))
    assert sums[1] > sums[0]


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    rng, scratch, seen = np.random.default_rng(7), Scratch(spark), []
    words = np.array(["red", "fox", "blue", "bird", "old", "house"])
    data = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([*rng.integers(0, 40, 300).tolist(), 30_000])] + [(400, None), (None, "red fox")]
    mean = lm_score.average

    def spy(weights, scratch):
        seen.append(weights.agg(F.sum("n").alias("n")).collect()[0].n)
        return mean(weights, scratch)

    monkeypatch.setattr(lm_score, "STEPS", 5)
    monkeypatch.setattr(lm_score, "average", spy)
    lm_score.fit(spark.createDataFrame(data, "doc_id long, text string").repartition(3), scratch)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    learned = [t or "" for i, t in data if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    assert max(seen) == sum(-(-(len(tok.encode(t, add_special_tokens=False).ids) + 1) // lm_score.STRIDE) for t in learned)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:80] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, 2.0]), (None, [1.0] * 8), (0, x[0].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)).tolist() if i != q][:10]
        hit += len(set(want) & {v for _, v, _ in got[q]})
        assert all(np.isclose(s, d[v]) for _, v, s in got[q])
    assert hit >= 57 and [v for _, v, _ in sorted(got[0])] == list(range(50, 60))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert rows(nearest.neighbours(few), "query_id", "rank", "vec_id") == [[0, 1, 1], [0, 2, 2]]
    assert nearest.neighbours(few.where("vec_id < 0")).count() == 0


def test_nearest_with_near_copies_and_a_far_vector(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:600] = x[100] + 1e-5 * rng.normal(size=(500, 16)).astype(np.float32)
    x[899] = 0
    x[899, 3] = 1e9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.neighbours(df, every=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 900, 50):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        hit += len({i for i in np.lexsort((np.arange(900), d)).tolist() if i != q and d[i] <= np.sort(d)[10]} & got[q])
    assert len(got) == 18 and hit >= 171


def test_tasks_drop_what_other_operators_keep_in_a_worker():
    from tessella.llm import bpe, common

    bpe.load.cache_clear()  # of what other tests have loaded in this process
    bpe.load(common.tokenizer_path("word_bpe_49k.json"))
    assert list(common.lean(iter, "tessella.llm.packing")([1, 2])) == [1, 2]
    assert bpe.load.cache_info().currsize == 1
    assert list(common.lean(iter, "tessella.llm.language_id")([])) == []
    assert bpe.load.cache_info().currsize == 0


def test_an_idle_worker_keeps_nothing(monkeypatch):
    from tessella.llm import common

    def wait(seconds, until):
        end = time.monotonic() + seconds
        while time.monotonic() < end and not until():
            time.sleep(0.02)

    monkeypatch.setattr(common, "IDLE", 0.3)
    bpe.load(common.tokenizer_path("word_bpe_49k.json"))
    assert list(common.lean(iter, "tessella.llm.packing")([1])) == [1]
    busy = common.lean(iter, "tessella.llm.packing")([1, 2])
    assert next(busy) == 1
    wait(0.8, lambda: False)
    assert bpe.load.cache_info().currsize == 1  # another task has begun
    assert list(busy) == [2]
    wait(10, lambda: not bpe.load.cache_info().currsize)
    assert bpe.load.cache_info().currsize == 0


def test_language_tables_take_small_symbols():
    """Per text and language a worker holds one byte a symbol where the alphabets are small; the parse is that of wide ones."""
    p = language_id.Parser(language_id.Model((("de", BASE[::-1] * 3), ("en", BASE * 3))))
    texts = [BASE, "zzz" + BASE * 40, "?"]
    assert {x.dtype.itemsize for x in p.own} == {1}
    narrow = p.phrases(texts)
    p.own = [x.astype(np.int32) for x in p.own]
    assert np.array_equal(narrow, p.phrases(texts))


def test_lm_gradients_are_slopes_of_the_loss():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 50, lm_score.VOCABULARY).astype(float)
    ids = [rng.integers(0, 300, n).astype(np.uint16) for n in (0, 5, 30, 70)]
    m = lm_score.train(ids, counts, rng.random(lm_score.VOCABULARY) < 0.5, steps=20)
    x, t, _, share = lm_score._windows(m, ids)
    got, n = lm_score.gradients(m, x, t.ravel()), (t >= 0).sum()
    loss = lambda: -(lm_score.score(m, ids) - share).sum() * np.log(10) / n
    for k in m.p:
        was, step = m.p[k], np.float32(0.01) * got[k] / np.sqrt((got[k] ** 2).sum())
        m.p[k] = was + step
        up = loss()
        m.p[k] = was - step
        down = loss()
        m.p[k] = was
        assert np.isclose((up - down) / 0.02, np.sqrt((got[k] ** 2).sum()), rtol=0.05, atol=2e-4), k


def test_lm_encodes_each_text_once(spark, monkeypatch):
    """Counting, learning and scoring work from the written ids alone: no worker encodes then."""
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "red fox"), (3, "again")]
    df, scratch = spark.createDataFrame(data, "doc_id long, text string").repartition(3), Scratch(spark)
    monkeypatch.setattr(lm_score, "STEPS", 5)
    rows = lm_score.encode_documents(df, scratch)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {(i, t): tok.encode(t or "", add_special_tokens=False).ids for i, t in data}
    assert {(r.doc_id, r.text): np.frombuffer(r.ids, "<u2").tolist() for r in rows.collect()} == want
    n = Counter(k for (i, _), ids in want.items() if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for k in ids)
    assert {k: v for k, v in enumerate(lm_score.count_ids(rows, 7, 2).tolist()) if v} == n
    monkeypatch.setattr(lm_score, "encode_documents", None)
    got = lm_score.score_documents(df, trained := lm_score.fit(df, scratch, rows=rows), scratch, rows=rows).collect()
    assert sorted((round(r.score, 2) for r in got)) == sorted(round(float(lm_score.score(trained.model, [np.array(x, np.uint16)])[0]), 2) for x in want.values())


def test_lm_kernel_scores_and_learns_as_numpy_does(spark):
    """Scores, word counts and three steps over the same windows, in the executors' JVM and in numpy."""
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 50, lm_score.VOCABULARY).astype(float)
    ids = [rng.integers(0, 3000, n).astype(np.uint16) for n in (0, 1, 11, 12, 13, 700, 4000)]
    m = lm_score.train(ids, counts, rng.random(lm_score.VOCABULARY) < 0.5, steps=60)
    assert lm_kernel.available(spark, (lm_score.WIDTH, lm_score.HIDDEN, lm_score.GROUPS), lm_score.SPAN, lm_score.STRIDE)
    sent = lm_kernel.blob(m, lm_score.SPAN, lm_score.STRIDE, lm_score.END_ID)
    texts = [None, "", " \t", "Red red RED fox\x1cfox \x0b fox", "É é Fox " * 40, "x" * 100, "fox"]
    words = sorted((lm_score.word_hash(w), float(k)) for k, w in enumerate([b"", b"red", b"x" * 100]))
    head, value = np.array([h for h, _ in words]), np.array([v for _, v in words])
    rows = spark.createDataFrame([(k, None if k == 1 else k, t, x.tobytes()) for k, (t, x) in enumerate(zip(texts, ids))], "row long, doc_id long, text string, ids binary").repartition(2)
    schema = "row long, doc_id long, n_tokens long, hit long, base double, score double, tail array<struct<h:bigint,k:int>>"
    for h, v in ((head, value), (head[:0], value[:0])):
        got = lm_kernel.run(rows.select("row", "doc_id", F.col("text").cast("binary"), "ids"), "Score", sent + lm_kernel.head_blob(h, v), schema).orderBy("row").collect()
        n, hit, base, tail = lm_score.WordCounts(h, v).of([lower(t or "").encode() for t in texts])
        assert [(r.doc_id, r.n_tokens, r.hit, r.base, [(x.h, x.k) for x in r.tail]) for r in got] == [(None if k == 1 else k, *x[:3], [(y["h"], y["k"]) for y in x[3]]) for k, x in enumerate(zip(n.tolist(), hit.tolist(), base.tolist(), tail.to_pylist()))]
        assert np.allclose([r.score for r in got], lm_score.score(m, ids), rtol=1e-5)
    x, t, _, _ = lm_score._windows(m, ids)
    one = spark.createDataFrame([(v.tobytes(),) for v in ids * 3], "ids binary").coalesce(1)
    (got,) = lm_kernel.run(one, "Learn", sent, "w binary, n long", len(x), 1, len(x) - 1, 0.01, 1).collect()
    adam = lm_score.Adam(lm_score.replace(m))
    for k in range(3):
        adam.go(x, t, 0.01 * min(1.0, (k + 1) / 20))
    want, have = adam.model.p, lm_score._unblob(bytes(got.w), m.p)
    assert got.n == 3 * len(x)
    for k in m.p:
        moved = np.abs(want[k] - m.p[k]).sum()
        assert moved > 0 and np.abs(have[k] - want[k]).sum() < 0.01 * moved, k


def test_lm_counts_words_in_parts(spark):
    """Also words beyond the first table of the kernel, long ones, and the ends of null and empty texts."""
    texts = [None, "", "  ", "Aa aA\x1c b\x0bb É", "x" * 70_000 + " x"] + [" ".join(f"w{k % 50_000}" for k in range(a, a + 30_000)) for a in range(0, 150_000, 30_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*lower(t or "").encode().split(), b""])
    assert {bytes(r.word): r.n for r in lm_score.count_words(df, 7, 2).collect()} == want


def test_lm_score_without_the_kernel(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "STEPS", 5)
    monkeypatch.setattr(lm_score, "ROUNDS", ())
    got = []
    for have in (lm_kernel.available, lambda *_: False):
        monkeypatch.setattr(lm_kernel, "available", have)
        scratch = Scratch(spark)
        rows = lm_score.score_documents(docs, lm_score.fit(docs, scratch, head=5), scratch).collect()
        got.append(sorted((repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))), r.score) for r in rows))
    assert [x for x, _ in got[0]] == [x for x, _ in got[1]]
    assert np.allclose([y for _, y in got[0]], [y for _, y in got[1]], rtol=1e-5)
