import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from framewell.llm.tokens import default_path
from test_secrets import plain as secret_spans
from test_simhash import shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and the last one's output, written and read again as the pipeline does."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        out.append(docs)
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return [*out, docs]


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "mixing", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:5])


def test_language_id_keeps_text_and_drops_the_rest(spark, stages):
    docs = stages[0]
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    noise = "".join(map(chr, np.random.default_rng(0).integers(33, 500, 3000)))
    odd = [(10**6, None, None, None, None), (10**6 + 1, "12 34 --", "en", "s", 8), (10**6 + 2, noise, None, "s", 1), (10**6 + 3, "The of and in the that is.", None, None, None)]
    kept = {r.doc_id for r in cp.language_id(spark, docs.union(spark.createDataFrame(odd, docs.schema)), SF).collect()}
    assert {i for i, *_ in odd} & kept == {10**6 + 3}
    assert cp.language_id(spark, docs.limit(0), SF).count() == 0


def test_one_of_each_group_stays(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    after = {r.doc_id: r.text for r in stages[2].collect()}
    shingles = {i: shingle_set(t) for i, t in before.items()}
    alike = {(i, j): len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) for i in before for j in before if i < j}
    gone = before.keys() - after.keys()
    assert after == {i: before[i] for i in after} and gone
    # nothing goes without one that is alike to 0.8, and links of 0.8 are found
    assert all(any(s >= 0.8 for (a, b), s in alike.items() if i in (a, b)) for i in gone)
    close = [p for p, s in alike.items() if s >= 0.8]
    assert sum(b in gone for _, b in close) >= 0.97 * len(close)
    assert not [p for p in close if p[0] in after and p[1] in after and alike[p] >= 0.85]


def test_secrets_are_redacted(spark, stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert set(before) == set(after)
    for i, text in before.items():
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in secret_spans(text))
        want, at = "", 0
        for a, b in spans:
            want += text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        assert after[i].text == want + text[at:] and after[i].n_chars == len(after[i].text)
    assert any("[SECRET]" in r.text for r in after.values()) or not any(map(secret_spans, before.values()))


def test_mix_is_on_target(stages):
    from framewell.llm import mixing

    words, source, taken = Counter(), {}, Counter()
    for r in stages[3].collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        words[r.source] += n
        source[r.doc_id] = n
    for r in stages[4].collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert n <= source[r.doc_id]
        taken[r.source] += n
    names = sorted(words)
    for name, target in zip(names, mixing.targets([words[n] for n in names])):
        assert abs(taken[name] - target) <= 0.5


def test_pieces_hold_all_ids_once(stages):
    tok = Tokenizer.from_file(default_path())
    want, got, full = Counter(), Counter(), defaultdict(list)
    for r in stages[4].collect():
        want[r.doc_id] += len(tok.encode(r.text, add_special_tokens=False).ids) + 1
    for r in stages[5].collect():
        got[r.doc_id] += r.length
        full[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(bytes(r.ids), "<u2").astype("<u4").tobytes())
    assert got == want
    lengths = [sum(n for _, n in full[s]) for s in range(len(full))]
    assert all(n == 4096 for n in lengths if n & (n - 1)) and max(lengths) <= 4096


def test_run_gives_the_last_stage(spark, stages):
    same = ["doc_id", "start", "length", "sequence_id", "offset", "ids_crc32"]
    assert sorted(cp.run(spark, SF).select(*same).collect()) == sorted(stages[5].select(*same).collect())
