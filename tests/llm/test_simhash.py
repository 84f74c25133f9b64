import random

import numpy as np
import xxhash

from framewell.llm import simhash
from framewell.llm.simhash import bk_links, bk_tree, fingerprint, keep_first, near_duplicates, op2_simhash_near_dedup, print_links, similar_documents

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WS[1:]:
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in zip(ids, prints):
        for j, q in zip(ids, prints):
            if bin(p ^ q).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_matches_its_definition():
    for text in ["", "   ", "One", "one Two", "a b c", "A\x0bb\tc d e É é", "x y z " * 50, "the cat sat on the mat " * 9000]:
        if len(text) < 1000:
            assert fingerprint(text.encode()) == plain(text), text
        assert fingerprint(text.encode(), chunk=7) == fingerprint(text.encode())


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    points = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(20)]))
    left, right = bk_links(bk_tree(points), points)
    want = {(int(a), int(b)) for a in points for b in points if int(a ^ b).bit_count() <= 2}
    assert {*zip(left.tolist(), right.tolist())} == want and len(left) == len(want)


def test_links_connect_chains_across_shards(spark):
    random.seed(5)
    prints = [random.getrandbits(64)]
    for _ in range(60):  # each step flips two bits anywhere
        prints.append(prints[-1] ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    prints += [random.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 3]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from framewell.plans.components import connected_components

    got = connected_components(print_links(spark.createDataFrame([(p,) for p in signed], "print long")))
    got = {r.node: r.component for r in got.collect()}
    want = classes(signed, prints)
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if list(want.values()).count(v) > 1}


def test_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 2), (2, "a b c d", 3), (2, "a b c d", 3), (None, "A B C D", 4), (9, "zz " * 50_000, 5)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, print long")).collect()
    assert len(got) == len(rows)
    assert {(r.id, r.component) for r in got} == {(3, 1), (1, 1), (2, 2), (None, 2), (9, 9)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [plain(d.text) for d in docs]
    want = classes([d.doc_id for d in docs], prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash_near_dedup(spark, sf).collect()}
    assert got == {d.doc_id: (f"{p:016x}", want[d.doc_id]) for d, p in zip(docs, prints)}


def shingle_set(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else {""}


def test_similar_documents_are_grouped(spark):
    rng = random.Random(4)
    rows, group = [], {}
    for g in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(80, 300))]
        for k in range(rng.choice([1, 1, 3, 6])):
            copy = list(words)
            for _ in range(k and max(1, len(words) // 100)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows) * 3 - 20, " ".join(copy), 0))
            group[rows[-1][0]] = g
    got = {r.id: r.component for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()}
    first = {}
    for i in sorted(group):
        first.setdefault(group[i], i)
    assert got == {i: first[g] for i, g in group.items()}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "one two"), (5, "One  two"), (None, "one two"), (5, "One  two"), (6, "z " * 100_000)], "doc_id long, text string")
    assert {(r.id, r.component) for r in similar_documents(odd).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (6, 6)}
    kept = keep_first(odd, similar_documents(odd))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6] and kept.columns == odd.columns
    assert similar_documents(odd.limit(0)).count() == 0
    assert simhash.tables_for(0.8, 10**9)[1] > simhash.tables_for(0.8, 1000)[1] == 16


def shard_batch(key, node, size, words, component, far, other):
    import pyarrow as pa

    columns = [key, node, size, *(words[:, k].view(np.int64) for k in range(simhash.WIDE)), component, far, other]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=list("abcdefghij"))


def test_candidates_of_shards_against_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 8, 9, 30, 1, 5, 60]
    key = np.repeat(np.arange(len(sizes)), sizes)
    n = len(key)
    words = np.zeros((n, simhash.WIDE), np.uint64)
    words[:, 0] = rng.integers(0, 1 << 5, n, dtype=np.uint64)
    words[:, 2] = rng.integers(0, 1 << 3, n, dtype=np.uint64) << np.uint64(40)
    node, size, component = rng.permutation(n) * 11, rng.integers(50, 70, n), rng.integers(0, 4, n)
    far, other = rng.integers(-1, 3, n), rng.permutation(n) * 11
    batch = shard_batch(key, node, size, words, component, far, other)
    place = {int(x): i for i, x in enumerate(node)}
    for few, k in ((2, 10**6), (8, 10**6), (8, 3)):
        monkeypatch.setattr(simhash, "FEW", few)
        parts = [batch.slice(0, 17), batch.slice(17, 0), batch.slice(17)]
        got = [tuple(r.values()) for b in simhash._candidates(2, 0.8, k, False)(parts) for r in b.to_pylist()]
        want = []
        for i in range(n):
            near = sorted((int(np.bitwise_count(words[i] ^ words[j]).sum()), int(node[j])) for j in range(n) if key[i] == key[j] and component[i] != component[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]))
            want += [(int(node[i]), o, d) for d, o in near if d <= 2 and (d, o) > (far[i], other[i])][:k]
        assert sorted(got) == sorted(want) and want
    # long fingerprints that tell odd nodes from even ones
    apart = np.where(np.arange(n)[:, None] % 2 == 0, np.uint64(0), ~np.uint64(0)).repeat(simhash.LONG, axis=1)
    import pyarrow as pa

    both = pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in apart], pa.binary())], names=list("abcdefghijk"))
    told = [tuple(r.values()) for b in simhash._candidates(2, 0.8, 10**6, False)([both]) for r in b.to_pylist()]
    every = [tuple(r.values()) for b in simhash._candidates(2, 0.8, 10**6, False)([batch]) for r in b.to_pylist()]
    assert sorted(told) == sorted(x for x in every if (place[x[0]] - place[x[1]]) % 2 == 0) != sorted(every)
    monkeypatch.setattr(simhash, "MIDDLE", 20)
    got = [tuple(r.values()) for b in simhash._candidates(2, 0.8, 1, True)([batch]) for r in b.to_pylist()]
    assert sorted(a for a, o, _ in got if o is None) == sorted(node[(key == 5) | (key == 8)].tolist())
    assert all(len({o for a, o, _ in got if o is not None and key[place[a]] == x}) == 1 for x in (5, 8))


def alike(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    return {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_links_are_those_of_the_whole_sets(spark, monkeypatch):
    """Groups around the threshold: nothing below 0.8 is joined, and links at 0.8 or more are found, however the rounds go."""
    rng, texts = random.Random(8), {}
    for g in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        for k in range(25):
            copy = list(words)
            for _ in range(k and rng.randint(1, max(2, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            texts[len(texts)] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = alike(texts)
    close = [p for p, s in pairs.items() if s >= 0.8]
    want = components(texts, close)
    for middle in (512, 9):
        monkeypatch.setattr(simhash, "MIDDLE", middle)
        got = {r.id: r.component for r in similar_documents(docs).collect()}
        assert all(want[i] == want[c] for i, c in got.items())  # joined by links of 0.8 or more alone
        assert sum(got[i] == got[j] for i, j in close) >= 0.97 * len(close)
    edge = [(i, j) for (i, j) in close if pairs[i, j] < 0.85]
    assert len(edge) > 50 and sum(got[i] == got[j] for i, j in edge) >= 0.95 * len(edge)


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    words = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdef"]
    rows = [(None, words[0], "x"), (None, words[1], "x"), (None, words[1], "w"), (7, words[2], "x"), (7, words[3], "x"), (2, words[3], "x"), (None, words[3], "x"), (1, words[4], "z"), (1, words[4], "y"), (None, None, "x")]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        kept = keep_first(docs, similar_documents(docs))
        want = [(None, words[0], "x"), (None, words[1], "w"), (7, words[2], "x"), (2, words[3], "x"), (1, words[4], "y"), (None, None, "x")]
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want)) and kept.columns == docs.columns


def test_rows_grow_with_the_nodes_of_a_group_and_not_with_its_pairs(spark, monkeypatch):
    """Near copies of one text, all pairs of them just below 0.8, and one copy of the first that is above."""
    rng, words = random.Random(5), [f"w{k}" for k in range(1500)]
    texts = []
    for _ in range(160):
        copy = list(words)
        for k in rng.sample(range(1500), 21):
            copy[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    made, write = {}, simhash.materialise

    def counted(df, tag):
        out = write(df, tag)
        made[-1] = made.get(-1, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    got = {}
    for n, compared in ((80, 500), (160, 500), (80, 20)):
        made[-1] = 0
        monkeypatch.setattr(simhash, "COMPARED", compared)
        rows = [*enumerate(texts[:n]), (1000, texts[0] + " more")]
        got[n, compared] = sorted((r.id, r.component) for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        made[n, compared] = made[-1]
    assert made[160, 500] < 2.6 * made[80, 500], made
    assert got[80, 20] == got[80, 500] and (1000, 0) in got[160, 500]
    pairs = alike(dict(enumerate(texts[:80])))
    assert max(pairs.values()) < 0.8 and [c for i, c in got[80, 500] if i < 1000] == [*range(80)]
