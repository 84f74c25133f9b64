import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from framewell.llm import mixing


def test_targets_fill_up_to_their_caps():
    sizes = [100, 1000, 10, 0, 500]
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s for t, s in zip(got, sizes))
    free = [k for k, (t, s) in enumerate(zip(got, sizes)) if 0 < t < 2 * s]
    weight = [5, 2, 1, 5, 2]
    assert len({round(got[k] / weight[k], 6) for k in free}) <= 1
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        x = mixing.permuted(np.arange(n), n, 5)
        assert sorted(x.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 5).tolist() != mixing.permuted(np.arange(1000), 1000, 6).tolist()


def test_tree_splits_quotas_exactly():
    quotas, leaves = [1000, 0, 37, 4], 13
    paths = [mixing.leaf_quotas(quotas, leaves, k, 3) for k in range(leaves)]
    assert [sum(x) for x in zip(*(held for _, held in paths))] == quotas
    assert max(sum(h) for _, h in paths) - min(sum(h) for _, h in paths) <= 1
    at = [0] * 4
    for first, held in paths:
        assert first == at
        at = [a + h for a, h in zip(at, held)]


def replayed(sized, plan, block=None):
    """The splitting tree played out in plain loops: (row, epoch) to words taken, and (row, epoch, start) to shard."""
    from pyspark.sql import functions as F

    order = sized.withColumn("h", F.xxhash64("key", "size", "tie", F.lit(plan.seed)))
    groups = {p["source"]: -(-p["docs"] // mixing.GROUP_DOCS) for p in plan.sources}
    streams = defaultdict(list)
    for r in sorted(order.filter("size > 0").collect(), key=lambda r: (r.h % groups[r.source], r.h, r.key is not None, r.key or 0, r.size, r.tie, r.row)):
        streams[r.source] += [(r.row, w) for w in range(r.size)]
    quotas, queues = [], []
    for k, p in enumerate(plan.sources):
        words, b = streams[p["source"]], int(plan.block[k])
        blocks = [words[i : i + b] for i in range(0, len(words), b)]
        queue, left = [], round(p["target"])
        for epoch in range(3):
            place = mixing.permuted(np.arange(len(blocks)), len(blocks), k * 64 + epoch + 1 + plan.seed) if blocks else []
            for i in np.argsort(place):
                if left > 0:
                    queue.append((epoch, blocks[i][:left]))
                    left -= len(queue[-1][1])
        quotas.append(len(queue))
        queues.append(queue)
    taken, shard_of = Counter(), {}
    for leaf in range(plan.shards):
        before, held = mixing.leaf_quotas(quotas, plan.shards, leaf, plan.seed)
        for queue, first, n in zip(queues, before, held):
            for epoch, words in queue[first : first + n]:
                for row, w in words:
                    taken[row, epoch] += 1
                    shard_of[row, epoch, w] = leaf
    return taken, shard_of


def test_draws_are_those_of_the_tree_played_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_DOCS", 16)
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), f"s{i % 7 if i % 3 else 0}") for i in range(200)] + [(5, None, None), (6, "a b", None), (None, "x y z", "s1"), (6, "a b", None), (7, "big " * 3000, "s2"), (8, "one", "lone")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, size int")
    for block, shards in ((64, 9), (None, 4)):
        sized, drawn, plan = mixing.mixed(df, block=block, shards=shards)
        taken, shard_of = replayed(sized, plan)
        got, seen = Counter(), {}
        for r in drawn.collect():
            got[r.row, r.epoch] += r.end - r.start
            for w in range(r.start, r.end):
                assert (r.row, r.epoch, w) not in seen
                seen[r.row, r.epoch, w] = r.shard
        assert got == taken and seen == shard_of and len(set(seen.values())) == shards
        source = {r.row: r.source for r in sized.collect()}
        by = Counter()
        for (row, _), n in got.items():
            by[source[row]] += n
        assert plan.sources[-1]["source"] is None
        assert all(by[p["source"]] == round(p["target"]) for p in plan.sources)


def test_small_sources_meet_their_targets():
    for sizes in ([200, 200, 200], [300, 5000, 90], [1, 2, 3], [7, 0, 900]):
        targets = mixing.targets(sizes)
        plan = mixing.Plan([{"size": s, "target": t} for s, t in zip(sizes, targets)], 7)
        words = plan.whole * plan.size + plan.rest
        assert np.abs(words - targets).max() <= 0.5 and (plan.part <= plan.count).all()


def test_query_contract_and_reruns(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(mixing.op5_mixing(spark, sf).collect())
    assert got == sorted(mixing.op5_mixing(spark, sf).collect())
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total, taken, turns = Counter(), Counter(), defaultdict(list)
    for r in got:
        d = docs[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) and 0 <= r.taken <= 2 * r.size
        pieces = [tuple(map(int, p.split(":"))) for p in r.layout.split(",") if p]
        assert r.taken == sum(p[2] - p[1] for p in pieces)
        for p in pieces:
            turns[p[3]].append(p[4])
        total[d.source] += r.size
        taken[d.source] += r.taken
    for r in got:
        s = docs[r.doc_id].source
        assert r.source_size == total[s] and abs(taken[s] - r.target) <= 0.5
    assert len(turns) >= mixing.LEAST_SHARDS and all(sorted(t) == list(range(len(t))) for t in turns.values())


def test_reruns_agree_however_rows_are_split(spark):
    rows = [(i % 5, f"t{i % 11} " * (i % 13 + 1), f"s{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = []
    for parts in (1, 7):
        sized, drawn, _ = mixing.mixed(df.repartition(parts), block=16)
        told.append(sorted(map(tuple, drawn.join(sized, "row").select("key", "size", "tie", "epoch", "start", "end", "shard", "place").collect())))
    assert told[0] == told[1]


def test_mixed_documents_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    want = {r.doc_id: r.taken for r in mixing.op5_mixing(spark, "/root/testdata/sf0.001").collect() if r.taken}
    assert dict(words) == want
    assert mixing.mixed(docs.limit(0))[1].count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_columns_may_have_any_names(spark):
    names = ["row", "runs", "epoch", "_mix_row", "shard", "place", "size", "key", "tie", "c0", "start"]
    rows = [(i, f"a{i} b c " * 30, "s", *[i] * len(names)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    out = mixing.mixed_documents(docs).collect()
    assert all(r[n] == r.doc_id for r in out for n in names) and {r.doc_id for r in out} == set(range(20))
    plain = mixing.mixed_documents(docs.select("doc_id", "text", "source")).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((r.doc_id, r.text) for r in plain)
