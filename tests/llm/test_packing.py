import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from framewell.llm import packing
from framewell.llm.tokens import default_path, word_ids


def check(rows, texts, window=4096):
    """Every id once, in sequences without gaps; None ids aside."""
    tok = Tokenizer.from_file(default_path())
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    assert sorted(seqs) == list(range(len(seqs)))
    lengths = []
    for s in sorted(seqs):
        at = 0
        for offset, n in sorted(seqs[s]):
            assert offset == at
            at += n
        lengths.append(at)
    assert all(n == window or n & (n - 1) == 0 and n < window for n in lengths) and sorted(lengths, reverse=True) == lengths
    return lengths


def test_word_ids_are_the_tokenizers():
    tok = Tokenizer.from_file(default_path())
    coder = word_ids()
    for text in ["", " ", "Hello  World.\n\nIt's 'tis  we'll", "É ế ́x y　z\x1cq", "a <|endoftext|> b<|startoftext|>", "<|ENDOFTEXT|> X", "ΑΣ ΣΑΣ. ΟΔΥΣΣΕΎΣ", "日本語 テキスト 123 4.5", "x\ty\x0bz\r\n\n q", "İstanbul K"]:
        assert np.frombuffer(coder.encode(text), "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    assert 49407 not in np.frombuffer(word_ids(plain_specials=True).encode("a <|endoftext|> b"), "<u2")


def test_word_ids_of_random_strings_are_the_tokenizers():
    tok, coder, rng = Tokenizer.from_file(default_path()), word_ids(), np.random.default_rng(5)
    letters = list("abzAZİIıßẞÉéñΣσςАяЖ日本ǅŉK0٣7½²")
    signs = list("!#$%&()*+,-./:;?@[]^_`{|}~'\"'’“—…€\u0301\u0307\u200d\u00ad")
    blanks = [" ", " ", " ", "\n", "\t", "\u00a0", "\u0085", "\u2028", "\u3000", "\x1c"]
    whole = ["<|endoftext|>", "<|startoftext|>", "GAZETESİ, 12 Mayıs", "BİRLİĞİ!", "it's", "we'll", "'S"]
    for _ in range(40):
        texts = []
        for _ in range(500):
            kinds = rng.choice(4, int(rng.integers(1, 14)), p=[0.55, 0.2, 0.2, 0.05])
            texts.append("".join(str(rng.choice((letters, signs, blanks, whole)[k])) for k in kinds))
        for text, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(coder.encode(text), "<u2").tolist() == e.ids, ascii(text)


def test_tail_is_powers_of_two():
    assert packing.sequence_bounds(4096 * 3) == (3, [12288])
    assert packing.sequence_bounds(4096 + 7) == (1, [4096, 4100, 4102, 4103])
    assert packing.sequence_bounds(0) == (0, [0])


def test_pieces_of_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "a b c", -5: "É " * 700}
    rows = [(i, t, s, 0, 0) for (i, t), s in zip(texts.items(), ["x", None, "x", "y", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, at long, ids long")
    check(packing.pack(df).collect(), texts)
    assert packing.pack(df.limit(0)).count() == 0
    again = packing.pack(df.union(df)).collect()
    assert sum(r.length for r in again) == 2 * sum(r.length for r in packing.pack(df).collect())
    assert packing.pack(spark.createDataFrame([(None, "a b", "s")], "doc_id long, text string, source string")).count() == 2


def test_windows_follow_the_weights_and_carry_deficits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["a"] * int(rng.integers(1, 700))), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    packed = packing.packets(df, packet=256)
    for weights in (None, {"hot": 3.0, "s1": 1.0}):
        stream, total = packing.streamed(packed, weights, 1024)
        got = sorted(stream.select("at", "length", "rank", "round", "upto", "quantum" if "quantum" in stream.columns else "rank").collect())
        at = 0
        for r in got:
            assert r[0] == at
            at += r[1]
        assert at == total
        # against a plain replay of deficit round-robin over the same queues
        queues, order = defaultdict(list), []
        for r in sorted(got, key=lambda r: (r[2], r[4])):
            queues[r[2]].append(r[1])
        sums = {k: sum(v) for k, v in queues.items()}
        names = sorted({r[2] for r in rows})
        share = sums if weights is None else {k: weights.get(n, 1.0) for k, n in enumerate(names)}
        quantum = {k: max(1, round(1024 * share[k] / sum(share.values()))) for k in queues}
        deficit, head = Counter(), Counter()
        while any(head[k] < len(q) for k, q in queues.items()):
            for k in sorted(queues):
                if head[k] < len(queues[k]):
                    deficit[k] += quantum[k]
                    while head[k] < len(queues[k]) and queues[k][head[k]] <= deficit[k]:
                        deficit[k] -= queues[k][head[k]]
                        order.append((k, queues[k][head[k]]))
                        head[k] += 1
        assert [(r[2], r[1]) for r in got] == order


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lengths = check(packing.op4_packing(spark, sf).collect(), texts)
    assert len(lengths) > 20
