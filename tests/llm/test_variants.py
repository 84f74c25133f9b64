import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framewell.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_vocabulary(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\\u00C0-\\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    out, forms = {}, {}
    for w, n in words.items():
        some = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = some[0] if some and -some[0][0] >= 2 * n else None
        forms[w] = form[1] if form else None
        out[w] = (n, len(some), forms[w], -form[0] if form else None)
    rows = []
    for w, (n, n_near, form, form_n) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def made(rng, n, letters, least=5, most=9):
    """Words of few letters, many of them near to others."""
    words = {"".join(rng.choice(list(letters), int(rng.integers(least, most + 1)))) for _ in range(n)}
    return {w: int(rng.integers(3, 60)) for w in words}


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(0)
    for n, kinds in ((1, 2), (2, 2), (50, 2), (333, 5), (64, 1)):
        text = rng.integers(0, kinds, n)
        assert variants.suffix_array(text).tolist() == sorted(range(n), key=lambda k: text[k:].tolist())
        ranks = variants.Ranks(text, kinds)
        at = np.arange(n + 1)
        assert ranks.every(at).tolist() == [np.bincount(text[:k], minlength=kinds).tolist() for k in at]


def test_intervals_of_both_directions_agree():
    rng = np.random.default_rng(1)
    words = [rng.integers(1, 4, int(rng.integers(1, 7))) for _ in range(60)]
    index = variants.FMIndex(words, 4)
    text = [0]
    for w in words:
        text += [*w.tolist(), 0]
    back = text[::-1]
    order, turned = sorted(range(len(text)), key=lambda k: text[k:]), sorted(range(len(text)), key=lambda k: back[k:])
    assert index.order.tolist() == order
    for _ in range(200):
        pattern, at = [0], index.of_separator(1)
        for _ in range(int(rng.integers(1, 6))):
            c, to_left = int(rng.integers(1, 4)), bool(rng.integers(2))
            at, pattern = index.step(at, np.array([c]), to_left), [c, *pattern] if to_left else [*pattern, c]
        hits = [k for k, i in enumerate(order) if text[i : i + len(pattern)] == pattern]
        turned_hits = [k for k, i in enumerate(turned) if back[i : i + len(pattern)] == pattern[::-1]]
        assert int(at[2][0]) == len(hits) == len(turned_hits)
        if hits:
            assert (int(at[0][0]), int(at[1][0])) == (hits[0], turned_hits[0])


@pytest.mark.parametrize(("letters", "n"), [("ab", 150), ("abcé", 400), ("abcdefgh", 500)])
def test_near_words_are_all_found(spark, letters, n):
    words = made(np.random.default_rng(n), n, letters, 1 if letters == "ab" else 4)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(variants.spelling_variants(df)) == brute(words)


def test_hot_beginnings_and_endings_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = {"re" + w if k % 3 == 0 else w + "ing" if k % 3 == 1 else w: n for k, (w, n) in enumerate(made(rng, 400, "abcd", 3, 6).items())}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(variants, "SHARD", 200)
    assert rows_of(variants.spelling_variants(df)) == brute(words)


def test_vocabulary_and_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "HOUSE house, hOuse×houſe houses ÀÉÎ house_x Ünïçødé"), (None, "house housse housse housse"), (None, "house"), (3, "horse " * 4)]
    docs += [(k, "common words variant " * 3 + "x" * 3000 + " " + "y" * 2000 + "x" * 1000) for k in range(200)] + [(k, "commen") for k in range(5)]
    schema = "doc_id long, text string, n long, word string, `a.b` long"
    df = spark.createDataFrame([(i, t, 0, "w", 0) for i, t in docs], schema).repartition(3)
    words = brute_vocabulary(docs)
    got = variants.vocabulary(df)
    assert {r.word: r.n for r in got.collect()} == words
    assert rows_of(variants.spelling_variants(got)) == brute(words)
    assert variants.spelling_variants(variants.vocabulary(df.limit(0))).count() == 0


def test_runs_are_those_of_the_pattern():
    for text in ("a÷b×c ÿÀ Ā ſ K aſb", "É\u0301x", "\U0001f600ab", "tab\tnl\nCR"):
        got = variants.edited_runs(7, text)
        want = Counter()
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text):
            run = run.translate(LOWER)
            h = zlib.crc32(f"7:{run}".encode())
            want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
        assert got == want
