import hashlib
import random
import re

import pytest

from framewell.llm import substrings


def plain(rows, span=20):
    """doc -> (n_words, kept words) by brute force over all windows."""
    texts = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", k[2]) for k in texts}
    first, gone = {}, {k: set() for k in texts}
    for k in texts:
        for s in range(len(words[k]) - span + 1):
            window = tuple(words[k][s : s + span])
            if first.setdefault(window, (k, s)) != (k, s):
                gone[k].update(range(s, s + span))
    return {k: (len(words[k]), " ".join(x for j, x in enumerate(words[k]) if j not in gone[k])) for k in texts}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(300)]
    some = lambda k: rng.choices(vocab, k=k)
    passages = [some(rng.choice([18, 20, 21, 35, 60, 200])) for _ in range(12)]
    line = some(11)
    rows = []
    for i in range(n):
        text = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            text += rng.choice([p, p, p[a:], p[:a]]) + some(rng.randint(0, 12))
        if i % 3 == 0:
            text += line + some(rng.choice([0, 5, 30])) + line
        if i % 10 == 0:
            text += ["same"] * rng.randint(15, 60) + some(3) + ["a", "b"] * rng.randint(5, 30)
        rows.append((rng.randint(-50, 10**6) * 1000 + i, rng.choice([" ", "  ", "\n", "\t"]).join(text)))
    rows += [(10**10 + k, rows[k][1]) for k in range(0, 30, 3)]
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, 1000), (2, 3), (3, 1)])
def test_against_brute_force(spark, seed, limit, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, pos int, runs string").repartition(7)
    monkeypatch.setattr(substrings.repeated_runs, "__defaults__", (limit,))
    want = {k[1]: v for k, v in plain(rows).items()}
    got = {r.id: (r.n_words, r.kept.decode()) for r in substrings.without_repeats(df).collect()}
    assert got == want
    assert sum(n - len(t.split()) for n, t in want.values()) > 1000


def test_join_in_place_of_the_broadcast(spark, monkeypatch):
    rows = corpus(9, 60)
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    got = {r.id: r.kept.decode() for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k[1]: v[1] for k, v in plain(rows).items()}


def test_odd_rows(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(25))
    rows = [(5, None), (6, ""), (7, a), (7, a), (None, b), (8, b + " x"), (7, a + " tail"), (9, "short text"), (10, "q " * 60_000), (4, a)]
    got = sorted(((r.id, r.n_words, r.kept.decode()) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = plain(rows)
    assert got == sorted(((i, *want[i is not None, i or 0, t or ""]) for i, t in rows), key=repr)
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = plain([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op10_substring_dedup(spark, sf).collect()}
    assert got == {k[1]: (n, n - len(t.split()), hashlib.sha256(t.encode()).hexdigest()) for k, (n, t) in want.items()}
    assert sum(g[1] for g in got.values()) > 0
