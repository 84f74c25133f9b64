import hashlib
import unicodedata

from framewell.llm import digests


def plain(rows):
    rows = sorted(((i, t or "", t) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, r[1]))
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    out = []
    for k, (i, t, _) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(fold(t) == fold(edited)), float(fold(t) == fold(after))))
    return sorted(out, key=repr)


def test_odd_rows_and_neighbours_across_ranges(spark):
    rows = [(i, f"Text {i // 3} é" * (i % 5)) for i in range(0, 90, 2)] + [(7, None), (9, ""), (None, "zz"), (7, "Ａ ﬁ"), (7, "Ａ ﬁ"), (111, "😀" * 1001), (112, "😀" * 1001), (113, "x " * 200_000), (114, "STRASSE"), (115, "straße"), (-4, "first")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kind string, task int").repartition(6)
    got = digests.with_next(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=repr) == plain(rows)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[114] == prints[115] and prints[111] == prints[112] and prints[114] != prints[113]
    assert digests.with_next(df.limit(0)).count() == 0
    alone = digests.with_next(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.n_chars == 2


def test_unequal_bytes_in_one_bucket_are_told_apart(spark):
    df = spark.createDataFrame([(1, "same"), (2, "Same "), (3, "other"), (4, None), (None, "same"), (5, "x"), (5, "x")], "doc_id long, text string")
    got = {r.id: r.fingerprint for r in digests.fingerprints(df).collect()}
    assert got[1] == got[2] == got[None] and len({got[1], got[3], got[4], got[5]}) == 4
    # a digest of the length alone makes buckets of unequal texts
    short = lambda data: f"n{len(data)}"
    told = sorted(((r.id, r.fingerprint) for r in digests.fingerprints(df, digest_of=short).collect()), key=repr)
    assert told == sorted([(1, "n4"), (2, "n4"), (None, "n4"), (3, "n5"), (4, "n0"), (5, "n1"), (5, "n1")], key=repr)
    df = spark.createDataFrame([(1, "same"), (2, "SAME"), (3, "text"), (4, "abcd"), (5, "x"), (6, "y")], "doc_id long, text string")
    told = {r.id: r.fingerprint for r in digests.fingerprints(df, digest_of=short).collect()}
    own = {i: x + "+" + hashlib.sha256(t).hexdigest() for i, x, t in [(1, "n4", b"same"), (2, "n4", b"same"), (3, "n4", b"text"), (4, "n4", b"abcd"), (5, "n1", b"x"), (6, "n1", b"y")]}
    assert told == own
    # through the query's own path: rows that repeat an id with other texts keep one row each
    odd = spark.createDataFrame([(1, "same"), (1, "text"), (1, "SAME"), (2, "longer one"), (None, None)], "doc_id long, text string")
    told = digests.exact_with_next(odd, digest_of=short).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in told), key=repr) == sorted([(1, own[1]), (1, own[3]), (1, own[1]), (2, "n10"), (None, "n0")], key=repr)
    assert all((r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0) for r in told)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = digests.op6_fingerprints(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=repr) == plain(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.fingerprint, set()).add(digests.canonical(dict(rows)[r.doc_id]))
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len({digests.canonical(t) for _, t in rows})
