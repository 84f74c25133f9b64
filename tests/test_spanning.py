import numpy as np
import pytest
from test_pivots import clustered, frame

from framewell.operators import neighbours, spanning
from framewell.plans import pivots


def brute_tree(x, k):
    """Edges (weight, a, b) of the tree by taking the shortest that joins two components."""
    far = np.array([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in x])
    core = np.sort(far, axis=1)[:, k - 1]
    reach = np.maximum(far, np.maximum(core[:, None], core[None]))
    root, out = list(range(len(x))), []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for w, a, b in sorted((reach[a, b], a, b) for a in range(len(x)) for b in range(a + 1, len(x))):
        if top(a) != top(b):
            root[top(a)] = top(b)
            out.append((w, a, b))
    return out


@pytest.mark.parametrize(("seed", "n", "dims", "block", "near"), [(1, 300, 2, 16, 6), (2, 240, 6, 8, 5), (3, 60, 3, 2048, 12)])
def test_the_tree_is_the_brute_force_one(spark, seed, n, dims, block, near):
    x = clustered(np.random.default_rng(seed), n, dims)
    df = frame(spark, x)
    some = neighbours.knn_join(df, df, near, block=block)
    rounds = []
    tree = spanning.spanning_tree(df, spanning.core_distances(some, 4), some, block, rounds)
    assert sorted((r.weight, r.a, r.b) for r in tree.collect()) == brute_tree(x, 4)
    assert all(r["blocks_met"] <= r["blocks"] ** 2 / 3 for r in rounds if r["blocks"] > 4), rounds


def test_few_rows(spark):
    df = frame(spark, np.zeros((3, 2)))
    near = neighbours.knn_join(df, df, 2)
    tree = spanning.spanning_tree(df, spanning.core_distances(near, 2), near).collect()
    assert sorted((r.a, r.b, r.weight) for r in tree) == [(0, 1, 0.0), (0, 2, 0.0)]
    assert spanning.spanning_tree(df.limit(1), spanning.core_distances(near, 2)).count() == 0


@pytest.mark.parametrize("broadcast", [spanning.BROADCAST, 0])
def test_searches_copy_no_block_for_those_it_meets(spark, monkeypatch, broadcast):
    plans = []

    def met(*args):
        out = pivots.all_with_all(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(spanning, "all_with_all", met)
    monkeypatch.setattr(spanning, "BROADCAST", broadcast)
    monkeypatch.setattr(pivots, "PART", 3000)
    x = clustered(np.random.default_rng(7), 160, 5)
    df = frame(spark, x)
    near = neighbours.knn_join(df, df, 4, block=16)
    tree = spanning.spanning_tree(df, spanning.core_distances(near, 3), near, 16)
    assert sorted((r.weight, r.a, r.b) for r in tree.collect()) == brute_tree(x, 3)
    assert plans and all("CartesianProduct" in p for p in plans)
