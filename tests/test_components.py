import random

import pytest

from framewell.plans import components
from framewell.plans.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("few", [0, 60, components.FEW])
def test_random_graph_chain_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    random.seed(3)
    order = random.sample(range(1000, 1300), 300)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + list(zip(order, order[1:])) + [(-5, -5), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), ).collect()}
    assert got == brute(edges)


def test_empty_and_null_ends(spark):
    df = spark.createDataFrame([(None, 1), (2, None)], "src long, dst long")
    assert connected_components(df).collect() == []


@pytest.mark.parametrize("few", [0, components.FEW])
def test_pointers_are_followed(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rows = [(f"w{k}", f"w{k + 1}") for k in range(40)] + [("a", "w7"), ("z", "z")]
    got = {r.node: r.root for r in components.settle(spark.createDataFrame(rows, "node string, root string")).collect()}
    assert got == {**{f"w{k}": "w40" for k in range(40)}, "a": "w40", "z": "z"}
    assert components.settle(spark.createDataFrame([], "node string, root string")).count() == 0
