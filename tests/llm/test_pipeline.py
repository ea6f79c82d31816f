"""The pipeline's five stages against plain Python on a small table with nulls, copies and repeated rows."""

import zlib

import numpy as np
import public_tokenizers

from tessella.llm import bpe


def test_pipeline_keeps_what_plain_python_keeps(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(60) for _ in range(14)]
    docs = [(i, t, "en") for i, t in enumerate(base)]
    docs += [(20, base[0], "en"), (21, base[1] + " " + words[0], "en"), (3, base[3], "en")]  # a copy, a near copy, a repeated row
    docs += [(30, None, "en"), (31, "too short", "en"), (32, "", None), (33, text(3000), "en")]
    docs += [(40, base[5].replace(" ", " one.person@mail.example.org ", 1) + " " + text(40), "en")]
    df = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    kept = {i: t for i, t, _ in docs if t and len(t.split()) >= 20 and i not in (20, 21)}
    assert {r.doc_id for r in got} == set(kept)
    assert sorted({r.doc_id for r in got}) == sorted(kept)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in kept.items():
        ids = tok.encode(t.replace("one.person@mail.example.org", "[EMAIL]"), add_special_tokens=False).ids + [1]
        copies = sum(d[0] == i for d in docs)
        assert sum(r.length for r in pieces[i]) == len(ids) * copies
        for r in pieces[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    place = {}
    for r in got:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in place.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "personal_data", "pack"]
