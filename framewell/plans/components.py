"""Connected components of an undirected graph whose edges are a DataFrame."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.session import materialise

#: Edges or pointers that one task takes to the end; rounds go on as long as there are more.
FEW = 10_000


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges (a, b), root being the smallest node reachable."""
    kind = edges.schema["a"].dataType

    def run(batches):
        top: dict = {}

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for b in batches:
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = find(top.setdefault(x, x)), find(top.setdefault(y, y))
                top[max(x, y)] = min(x, y)
        if top:
            yield pa.RecordBatch.from_pydict({"node": pa.array([*top], b.column(0).type), "root": pa.array([find(x) for x in top], b.column(0).type)})

    return edges.select("a", "b").repartition(1).mapInArrow(run, f"node {kind.simpleString()}, root {kind.simpleString()}")


def _followed(parent: DataFrame) -> DataFrame:
    kind = parent.schema["node"].dataType.simpleString()

    def run(batches):
        up: dict = {}
        for b in batches:
            up.update(zip(*(c.to_pylist() for c in b.columns), strict=True))
        for node in [*up]:
            path, at = [], node
            while at in up and up[at] != at:
                path.append(at)
                at = up[at]
            for x in path:
                up[x] = at
        if up:
            yield pa.RecordBatch.from_pydict({"node": pa.array([*up], b.column(0).type), "root": pa.array([*up.values()], b.column(0).type)})

    return parent.select("node", "root").repartition(1).mapInArrow(run, f"node {kind}, root {kind}")


def settle(parent: DataFrame) -> DataFrame:
    """Follow (node, root) pointers until every root points to itself; each pass halves the remaining depth."""
    parent = materialise(parent.select("node", "root"), "pointers")
    n = parent.limit(FEW + 1).count()
    if 0 < n <= FEW:
        return materialise(_followed(parent), "pointers")
    while n:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        parent = materialise(
            parent.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), (F.coalesce("_up", "root") != F.col("root")).alias("_moved")),
            "pointers",
        )
        if parent.filter("_moved").isEmpty():
            return parent.select("node", "root")
        parent = parent.select("node", "root")
    return parent


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Rounds of hooking and contraction: each node points to its smallest neighbour if that is smaller, the
    pointers are shortened to their roots, and the edges between different roots go on to the next round.
    Every node that is not the smallest around it hooks, so each round at least halves what still has edges,
    and long chains take logarithmically many rounds. The last FEW edges are joined in one task. Self-loops and null
    ends carry no link.
    """
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    every = materialise(ends.distinct(), "edges")  # once: what finds the edges may be the larger part of the work
    loops, live = every.filter("a = b").select("a"), every.filter("a <> b")
    label = None
    while n := live.limit(FEW + 1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low")).select("node", F.least("node", "_low").alias("root"))
        parent = settle(parent) if n > FEW else materialise(_joined(live), "joined")
        if label is None:
            label = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            label = materialise(label.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "labels")
        if n <= FEW:
            break
        ra = parent.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
        rb = parent.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
        live = live.join(ra, "a").join(rb, "b").filter("_ra <> _rb").select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b"))
        live = materialise(live.distinct(), "edges")
    if label is None:
        return loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    # A node's own loop says nothing new once the node has another edge.
    rest = loops.join(label, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return label.select("node", F.col("root").alias("component")).unionByName(rest)
