import hashlib
import random
import re

from pyspark.sql import functions as F

from framewell.llm import secrets
from framewell.llm.trigrams import trigram_query, trigrams

CONTRACT = [  # kind, expression, group, characters, flags: as the contract words them
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, False),
    ("hex", r"[0-9a-f]+", 0, 24, False),
]


def plain(text):
    found = []
    for k, (kind, pattern, group, least, any_case) in enumerate(CONTRACT):
        head = re.sub("password|passwd|secret|token|api|key", lambda m: "".join(f"[{c}{c.upper()}]" for c in m[0]), pattern) if any_case else pattern
        for m in re.finditer(head, text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def texts():
    random.seed(11)
    bits = ["token", "ToKeN", "api_key", "APIKEY", "secret", "passwd", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "é", "😀", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "ſecret", "İ", "\n", "k", "K"]
    out = ["".join(random.choices(bits, k=random.randint(1, 30))) for _ in range(400)]
    return out + [None, "", "secret=token: abcdefgh", "token=" + "a" * 50_000, "x😀" * 30_000 + " password: hunter22", "f" * 24, "token=abcdef " * 400]


def test_spans_match_the_contract(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[5], (None, "api_key = 'zzzzzz'"), (7, "secret: 999999")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, rules string")
    got = secrets.scan(df).select("id", "text", secrets.spans_text(F.filter("spans", lambda s: s["ord"] < 3)).alias("base")).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, t or "", ",".join(plain(t))) for i, t in rows), key=key)
    assert sorted(((r.id, r.text, r.base) for r in got), key=key) == want
    assert sum(bool(w[2]) for w in want) > 50


def test_more_kinds_add_spans(spark):
    jwt = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    text = f"-----BEGIN RSA PRIVATE KEY----- ghp_{'A1' * 18} {jwt}"
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[s.start : s.end] for s in row.spans] == ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "A1" * 18, jwt]


def test_trigram_queries_hold_for_every_match():
    assert trigram_query(r"[0-9a-f]{24,}") is True
    assert trigrams(trigram_query("AKIA[A-Z0-9]+")) == {"aki", "kia"}
    query = trigram_query(secrets.BASE[0].pattern)

    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        assert holds(query, f"{word}=abcdef")
    assert not holds(query, "pass word sec ret")
    for pattern, text in [("ab(c|d)?ef", "abef"), ("(foo|bar)+baz", "foobarbaz"), ("x{2}yz", "xxyz"), ("a.cdef", "abcdef"), ("^start", "start")]:
        assert re.search(pattern, text) and holds(trigram_query(pattern), text)


def holds(q, text):
    return q is True or (q in text if isinstance(q, str) else (all if q[0] == "and" else any)(holds(p, text) for p in q[1]))


def test_index_gives_all_matches(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    monkeypatch.setattr(secrets, "RANGE", 50)
    kept = {r.key: set(r.rules) for r in secrets.candidates(df).collect()}
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(secrets.RULES)}
    for r in df.withColumn("key", F.xxhash64("doc_id")).collect():
        want = {k for k, q in queries.items() if q is not True and holds(q, (r.text or "").lower())}
        assert kept.get(r.key, set()) == want or any(ord(c) > 127 for c in r.text)
        assert not any(s.startswith("assign") for s in plain(r.text)) or 0 in kept[r.key]
    assert len(kept) < df.count()


def test_any_number_of_rules_and_trigrams(spark):
    words = ["".join(random.Random(k).choices("abcdefghijklmnop", k=7)) for k in range(80)]
    rules = tuple(secrets.Rule(f"k{n:02d}", w) for n, w in enumerate(words))
    assert len(set().union(*(trigrams(trigram_query(w)) for w in words))) > 200
    df = spark.createDataFrame([(1, " ".join(words[70:])), (2, words[3]), (3, "none")], "doc_id long, text string")
    got = {r.id: [s.kind for s in r.spans] for r in secrets.scan(df, rules).collect()}
    assert got == {1: [f"k{n}" for n in range(70, 80)], 2: ["k03"], 3: []}


def test_redaction_and_empty_table(spark):
    df = spark.createDataFrame([(1, "é token=abcdef0 and AKIA" + "B" * 20 + "."), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.id: r.out for r in secrets.scan(df).select("id", secrets.redacted(F.col("text"), F.col("spans")).alias("out")).collect()}
    assert got == {1: "é [SECRET] and [SECRET].", 2: "", 3: "clean"}
    assert secrets.scan(df.limit(0)).count() == 0


def test_redaction_of_many_and_overlapping_spans(spark):
    rng, rows = random.Random(2), []
    for i, n in enumerate([1, 2, 63, 64, 65, 128, 129, 700]):
        text = "".join(rng.choices("abé😀 ", k=n * 9))
        rows.append((i, text, sorted((a, rng.randrange(3), min(len(text), a + rng.randint(1, 12)), "k") for a in (rng.randrange(len(text)) for _ in range(n)))))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,ord:int,end:int,kind:string>>")
    for r in df.withColumn("out", secrets.redacted(F.col("text"), F.col("spans"))).collect():
        want, at = "", 0
        for s in r.spans:
            want += r.text[at : s.start] + "[SECRET]" if s.start >= at else ""
            at = max(at, s.end)
        assert r.out == want + r.text[at:]


def test_query_has_native_plan_and_digest(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    df = secrets.op1_secret_scan(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r, t in zip(sorted(df.collect()), sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()), strict=True):
        assert r.doc_id == t[0] and r.base_sha256 == hashlib.sha256(",".join(plain(t[1])).encode()).hexdigest()
