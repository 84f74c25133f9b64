import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from framewell.llm import langid


def plain_bits(texts, data):
    """Method C over order 3 with all bytes as symbols; equal where every byte seen has its own symbol."""
    fold = lambda b: bytes(x + 32 if 65 <= x <= 90 else x for x in b)
    trees = defaultdict(Counter)
    for t in texts:
        s = b"   " + fold(t)
        for i in range(3, len(s)):
            for k in range(4):
                trees[s[i - k : i]][s[i]] += 1
    s, bits = b"   " + fold(data), 0.0
    for i in range(3, len(s)):
        p = 1.0
        for k in (3, 2, 1, 0):
            c = trees.get(s[i - k : i])
            if c and s[i] in c:
                p *= c[s[i]] / (c.total() + len(c))
                break
            if c:
                p *= len(c) / (c.total() + len(c))
        else:
            p /= 256
        bits -= math.log2(p)
    return bits


def test_code_lengths_are_exact(spark):
    texts = {"a": ["abra cadabra abra", "Abracad"], "b": ["xyzzy xyz zyx yx"]}
    rows = [(i, t, k) for k, ts in texts.items() for i, t in enumerate(ts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == ["a", "b"]
    for probe in [b"abra zyx", b"x", b"cad\xc3\xa9 abra", b"abracadabra" * 40]:
        got = langid.code_lengths(probe, *langid.compile_model(model))
        assert got.tolist() == pytest.approx([plain_bits([t.encode() for t in texts[k]], probe) for k in "ab"], rel=1e-5)
        assert langid.code_lengths(probe, *langid.compile_model(model), block=3).tolist() == pytest.approx(got.tolist(), rel=1e-6)


def test_odd_rows(spark):
    train = spark.createDataFrame([(1, "hello there you", "en"), (2, None, "en"), (3, "hola que tal", None), (4, "hola que tal estas", "es"), (4, "hola que tal estas", "es")], "doc_id long, text string, lang string")
    model = langid.train(train)
    rows = [(1, None, "x"), (None, "hello you", "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "que tal " * 100_000, "x"), (4, "que tal", "x"), (5, "日本", "x"), (6, "² ½ ① Ⅷ 3", "x")]
    got = [(r.id, r.lang_pred) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()]
    assert got[:6] == [(1, "und"), (None, "en"), (2, "und"), (3, "und"), (4, "es"), (4, "es")] and got[6][1] in ("en", "es") and got[7] == (6, "und")
    empty = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.predict(train, empty).collect()} == {"und"}
    assert langid.predict(train.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op7_language_id(spark, sf).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98


def unspaced(seed, first, n=60):
    """A text without blanks in one of two languages of three-byte characters, 300 of them from first on."""
    rng = random.Random(seed)
    return "".join(chr(first + min(rng.randrange(300), rng.randrange(300))) for _ in range(n))


def test_rare_bytes_keep_their_own_symbols(spark):
    import corpus_pipeline as cp

    common = [(i, " ".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz ABC 0123456789 .,;:!?-()/ the of and".split() + [*"abcdefghijklmnopqrstuvwxyz0123456789.,;:!?-()/"], k=200)), "en") for i in range(400)]
    rare = [(1000 + k * 100 + i, unspaced(k * 100 + i, first), lang) for k, (lang, first) in enumerate([("ja", 0x4E00), ("zh", 0x6C00)]) for i in range(40)]
    model = langid.train(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"))
    lang = model["langs"].index("zh")
    probe = unspaced(9999, 0x6C00)
    want = plain_bits([t.encode() for _, t, x in rare if x == "zh"], probe.encode())
    assert langid.code_lengths(probe.encode(), *langid.compile_model(model))[lang] == pytest.approx(want, rel=1e-5)
    fresh = [(5000 + k * 100 + i, unspaced(7000 + k * 100 + i, first), lang) for k, (lang, first) in enumerate([("ja", 0x4E00), ("zh", 0x6C00)]) for i in range(20)]
    docs = spark.createDataFrame(common + rare + fresh, "doc_id long, text string, lang string")
    got = {r.id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rare + fresh)
    assert langid.keep_identified(docs, model, cp.REJECT_BITS).count() == docs.count()
