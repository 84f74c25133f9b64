import sys

import numpy as np
import pytest
from test_pivots import frame
from test_spanning import brute_tree

from framewell.operators import cluster, hierarchy


def brute_labels(tree, n, size, leaf=False):
    """From the top: cut the longest edge, keep what is large enough, choose by excess of mass. Labels by smallest member."""
    sys.setrecursionlimit(10_000)
    least = min(w for w, *_ in tree if w > 0)
    clusters = []  # (mass, kids, members), kids before parents

    def parts(members, edges):
        root = {i: i for i in members}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for _, a, b in edges:
            root[max(top(a), top(b))] = min(top(a), top(b))
        out = {}
        for i in members:
            out.setdefault(top(i), set()).add(i)
        return [(m, [e for e in edges if e[1] in m]) for m in out.values()]

    def grow(members, edges, since):
        everyone, mass = set(members), 0.0
        while True:
            w = edges[-1][0]
            density = 1 / max(w, least)
            halves = parts(members, edges[:-1])
            large = [h for h in halves if len(h[0]) >= size]
            if len(large) == 1:
                mass += (len(members) - len(large[0][0])) * (density - since)
                members, edges = large[0]
                continue
            mass += len(members) * (density - since)
            clusters.append((mass, [grow(m, e, density) for m, e in large], everyone))
            return len(clusters) - 1

    grow(set(range(n)), sorted(tree), 0.0)
    best, good = [], []
    for mass, kids, _ in clusters:
        below = sum(best[k] for k in kids)
        good.append(not kids if leaf else not kids or mass >= below)
        best.append(max(mass, below) if kids else mass)
    chosen, look = [], [(len(clusters) - 1, True)]
    while look:
        k, is_root = look.pop()
        if good[k] and not is_root:
            chosen.append(clusters[k][2])
        else:
            look += [(j, False) for j in clusters[k][1]]
    labels = dict.fromkeys(range(n), -1)
    for name, members in enumerate(sorted(chosen, key=min), 1):
        labels.update(dict.fromkeys(members, name))
    return labels


def uneven(rng, sizes, dims=2):
    """Groups of very unequal density, some inside others, noise between, and equal rows."""
    parts = [rng.normal(rng.normal(0, 6, dims), 10.0 ** rng.uniform(-2, 0.3), (n, dims)) for n in sizes]
    return np.concatenate([*parts, rng.uniform(-15, 15, (sum(sizes) // 6, dims)), np.repeat(parts[0][:1], 6, axis=0)])


def labels_of(spark, tree, n, size, leaf, edges_in_task):
    df = spark.createDataFrame([(a, b, float(w)) for w, a, b in tree], "a long, b long, weight double")
    rows = spark.range(n).select("id").toDF("image_id")
    return {r.image_id: r.cluster_id for r in hierarchy.hierarchy_labels(df, rows, size, leaf, edges_in_task).collect()}


@pytest.mark.parametrize(("seed", "size", "leaf", "in_task"), [(1, 5, False, 1000), (2, 4, False, 16), (3, 8, True, 60)])
def test_labels_are_those_of_the_whole_hierarchy(spark, seed, size, leaf, in_task):
    rng = np.random.default_rng(seed)
    x = uneven(rng, [40, 25, 60, 12, 30])
    tree = brute_tree(x, 3)
    want = brute_labels(tree, len(x), size, leaf)
    assert len(set(want.values())) > 3
    assert labels_of(spark, tree, len(x), size, leaf, in_task) == want


def test_chains_and_equal_weights(spark):
    rng = np.random.default_rng(7)
    tree = [(float(rng.integers(1, 4)), k, k + 1) for k in range(60)]  # a path with few weights
    assert labels_of(spark, sorted(tree), 61, 3, False, 8) == brute_labels(sorted(tree), 61, 3)


def test_few_rows(spark):
    assert labels_of(spark, [(0.0, 0, 1), (0.0, 1, 2)], 3, 2, False, 10) == {0: -1, 1: -1, 2: -1}
    assert labels_of(spark, [(1.0, 0, 1)], 2, 5, False, 10) == {0: -1, 1: -1}
    assert cluster.density_labels(frame(spark, np.zeros((1, 2))), 5).collect()[0].cluster_id == -1
