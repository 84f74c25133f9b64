import numpy as np
from tokenizers import Tokenizer

from framewell.llm import separators
from framewell.llm.tokens import default_path


def test_scan_stitches_documents_across_blocks(spark):
    rng, rows, want = np.random.default_rng(4), [], []
    for file, (n, p) in enumerate([(1000, 0.02), (64, 0.9), (500, 0), (1, 1), (129, 0.01), (640, 0.001)]):
        ids = np.where(rng.random(n) < p, 9, rng.integers(10, 99, n)).astype("<u2")
        rows += [(file, k, ids[64 * k : 64 * k + 64].tobytes()) for k in range(-(-n // 64))]
        start = 0
        for ordinal, end in enumerate([*np.flatnonzero(ids == 9), *([n] if ids[-1] != 9 else [])]):
            want.append((file, ordinal, start, int(end) - start))
            start = int(end) + 1
    rows.append((77, 0, None))
    df = spark.createDataFrame([(*r, 0) for r in rows], "file long, block long, ids binary, ends int").repartition(3)
    got = separators.scan(df, end=9, block=64).collect()
    assert sorted((r.file, r.ordinal, r.start, r.n_tokens) for r in got) == sorted(want)
    assert separators.scan(df.limit(0)).count() == 0


def test_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (3, "c <|endoftext|> d"), (4, "long " * 70_000), (4, "long " * 70_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, file int")
    blocks, order = separators.flat_files(df, block=1000)
    got = sorted(((r.doc_id, r.n_tokens) for r in separators.scan(blocks, block=1000).join(order, ["file", "ordinal"]).collect()), key=repr)
    tok = Tokenizer.from_file(default_path())
    tok.encode_special_tokens = True
    assert got == sorted(((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)


def test_query_against_the_tokenizer(spark):
    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(default_path())
    tok.encode_special_tokens = True
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in separators.op3_token_counts(spark, sf).collect()} == want
