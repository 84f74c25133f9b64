import math
import re
from collections import Counter, defaultdict

import numpy as np

from framewell.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    """[(item_id, rank, doc_id, score)] by scoring every document."""
    vectors = [(i, Counter(terms(t))) for i, t in docs]
    vectors = [(i, c, sum(c.values())) for i, c in vectors if c]
    n, length = len(vectors), sum(x for *_, x in vectors)
    df = Counter(t for _, c, _ in vectors for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in vectors:
            m, score = 100 - 25 + (25 * size * n) // length, 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)]
    odds = 1 / np.arange(1, 301)
    text = lambda size: " ".join(rng.choice(words, size, p=odds / odds.sum()))
    return [(k, text(int(rng.integers(0, 60)))) for k in range(n)], [(k, text(int(rng.integers(1, 12)))) for k in range(15)]


def test_terms_are_the_patterns():
    for text in ("A-b_c Ünï9 ÀB\x00c\x7fd", "日本 ＡB x", "", "İK", "\u0085z"):
        assert [t.decode() for t in ranked.terms_of(text.encode())] == terms(text)


def test_as_by_scoring_every_document(spark):
    docs, items = corpus(700, 4)
    docs += [(10_000 + k, docs[7][1]) for k in range(350)]  # a third are copies
    items.append((99, docs[7][1]))
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for tree, parts in ((ranked.SHARD, 1), (64, 5)):
        ranked.SHARD, before = tree, ranked.SHARD
        try:
            assert rows_of(ranked.ranked_search(df.repartition(parts), asked)) == brute(docs, items)
        finally:
            ranked.SHARD = before
    before, ranked.ITEM_TERMS = ranked.ITEM_TERMS, 40  # several blocks of items
    try:
        assert rows_of(ranked.ranked_search(df, asked, top=3)) == brute(docs, items, 3)
    finally:
        ranked.ITEM_TERMS = before


def test_bounds_spare_most_nodes():
    rng = np.random.default_rng(1)
    docs = []
    for k in range(4000):
        path = np.unique(rng.zipf(1.3, 12) % 2000)
        docs.append((path.astype(">u4").tobytes(), rng.integers(1, 4, len(path)).astype("<i8").tobytes(), int(rng.integers(80, 120)), k))
    tree = ranked.Tree(list(docs), 20)
    weights = np.zeros(2001, np.int64)
    weights[[900, 1200, 3, 40]] = 7000, 8000, 500, 2000
    best, looked = tree.search(weights, [], 20)
    scores = []
    for path, tf, m, k in docs:
        t = np.frombuffer(path, ">u4").astype(np.int64)
        scores.append((-int((weights[t] * ranked.gain(np.frombuffer(tf, "<i8"), np.int64(m))).sum()), False, k))
    assert best == sorted(s for s in scores if s[0] < 0)[:20]
    assert looked < len(tree.child_run) / 2


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a c"), (-1, "... !"), (4, "x " * 50_000 + "a")]
    items = [(1, "a"), (1, "a"), (1, "c c"), (2, None), (3, "!!"), (4, "unknown"), (None, "x b")]
    df = spark.createDataFrame([(i, t, 0, 0, "e") for i, t in docs], "doc_id long, text string, n long, score long, `a.b` string")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, terms long")
    assert rows_of(ranked.ranked_search(df, asked)) == brute(docs, [(1, "a"), (1, "c c"), *items[3:]])
    assert ranked.ranked_search(df.limit(0), asked).count() == 0
    assert ranked.ranked_search(df, asked.limit(0)).count() == 0
    none = ranked.ranked_search(df.limit(2), asked)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0
