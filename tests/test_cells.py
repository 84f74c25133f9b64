import hashlib
import re

import numpy as np
import pytest

from framewell.functions.hashes import token_simhash
from framewell.operators import dedup
from framewell.plans import cells


@pytest.fixture(scope="module")
def values():
    """Near copies of 30 hashes, a class of equal ones, and others."""
    rng = np.random.default_rng(4)
    some = rng.integers(0, 1 << 63, 30).tolist()
    near = [some[int(rng.integers(30))] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 8)), replace=False)) for _ in range(300)]
    every = near + [near[0]] * 40 + rng.integers(0, 1 << 63, 60).tolist()
    return np.array(every, np.uint64).view(np.int64)


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values.tolist())), "image_id long, phash long").repartition(3)


def shuffles(df):
    """Exchanges, joins and aggregates behind the step that finds the pairs, and before it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    after, before = plan.split("MapInArrow", 1)
    return [sum(part.count(k) for k in ("Exchange", "Join", "Aggregate")) for part in (after, before)]


@pytest.mark.parametrize(("cell", "step"), [(cells.CELL, cells.STEP), (24, 100)])
def test_candidates_are_each_told_once_and_never_shuffled(spark, monkeypatch, values, cell, step):
    monkeypatch.setattr(cells, "CELL", cell)
    monkeypatch.setattr(cells, "STEP", step)
    n, bands = len(values), values.view(np.uint8).reshape(-1, 8)
    shared = (bands[:, None] == bands[None]).sum(axis=2)
    found = dedup.lsh_candidates(frame(spark, values))
    assert sorted(map(tuple, found.collect())) == [(i, j, int(shared[i, j])) for i in range(n) for j in range(i + 1, n) if shared[i, j] >= 2]
    assert shuffles(found)[0] == 0


@pytest.mark.parametrize(("cell", "step"), [(cells.CELL, cells.STEP), (24, 100)])
@pytest.mark.parametrize("bands", [None, 10])
def test_pairs_of_images_are_each_told_once_and_never_shuffled(spark, monkeypatch, values, cell, step, bands):
    monkeypatch.setattr(cells, "CELL", cell)
    monkeypatch.setattr(cells, "STEP", step)
    n, far = len(values), np.bitwise_count((values[:, None] ^ values[None]).view(np.uint64))
    found = dedup.near_pairs(frame(spark, values), 6, bands)
    assert sorted(map(tuple, found.collect())) == [(i, j, int(far[i, j])) for i in range(n) for j in range(i + 1, n) if far[i, j] <= 6]
    assert shuffles(found)[0] == 0


def test_links_of_classes_are_each_told_once_and_never_shuffled(spark, monkeypatch, values):
    monkeypatch.setattr(cells, "CELL", 24)
    first = {}
    for i, v in enumerate(values.tolist()):
        first.setdefault(v, i)
    far = {(i, j): (x ^ y) & (1 << 64) - 1 for x, i in first.items() for y, j in first.items() if i < j}
    found = dedup.class_links(frame(spark, values))
    assert sorted(map(tuple, found.collect())) == sorted((*k, x.bit_count()) for k, x in far.items() if x.bit_count() <= 6)
    assert shuffles(found)[0] == 0


def test_components_over_cells_cut_in_parts(spark, monkeypatch, values):
    monkeypatch.setattr(cells, "CELL", 24)
    monkeypatch.setattr(cells, "STEP", 100)
    far, root = np.bitwise_count((values[:, None] ^ values[None]).view(np.uint64)), np.arange(len(values))
    for _ in values:
        root = np.where(far <= 6, root[None], len(values)).min(axis=1)
    df = frame(spark, values)
    assert {r.image_id: r.component for r in dedup.components(df).collect()} == dict(enumerate(root.tolist()))
    edges = dedup.hash_edges(df.select("phash").distinct()).collect()
    assert len(edges) <= 7 * len(values)


def test_hashes_of_texts_are_made_where_the_texts_are_read(spark):
    texts = [(1, "a b c"), (1, "d\te"), (2, None), (3, ""), (4, " \n\r\t "), (5, "x y \x0bz\x0c q  w"), (6, "é è"), (6, None), (7, "one two " * 700 + "three")]

    def brute(rows):
        tokens, out = {}, {}
        for i, text in rows:
            tokens.setdefault(i, []).extend(t for t in re.split("[ \n\r\t]+", text or "") if t)
        for i, some in tokens.items():
            h = [int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big", signed=True) for t in some]
            value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
            out |= {i: value - (value >> 63 << 64)} if h else {}
        return out

    for rows in (texts, [r for r in texts if r[0] not in (1, 6)]):
        found = token_simhash(spark.createDataFrame(rows, "doc_id int, text string").repartition(2), "doc_id", "text")
        assert {r.id: r.phash for r in found.collect()} == brute(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # no row a token
