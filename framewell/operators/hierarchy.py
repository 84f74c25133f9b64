"""The whole density hierarchy of a spanning tree, and the clusters that hold most excess of mass.

Taking the tree's edges from the shortest on, each edge merges two components; the merges are the hierarchy. To find the
two sides of every merge, ranges of the sorted edges are halved: the lower half's components are contracted to one node
each in the upper half, and both halves go on at once, so the levels grow with the logarithm of the edges. A range of
LEAF edges is walked edge by edge in one task. A component is named by its smallest node; the merges a name takes part
in, by rank, are each other's children and parents.

A merge is big if its result has `size` members. Of the big ones, those of two big sides are splits, seen from above;
those of none are where a cluster first comes up; the others only add to a cluster. So clusters are chains of big merges,
each from a split or a first one (which names it) up to the next split. Points leave a cluster at the density, one
divided by the weight, of the merge that added them; a cluster's mass is the sum over its points of the density at which
they leave it less that at which it came off its parent. Clusters are chosen if their mass is no less than the best
choice below them. Chains are followed by doubling and the choice is made by contracting the tree of clusters, whose
nodes with one child to be told are functions max(a, b + x) of that child, so rounds grow with the logarithm as well.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.plans.components import connected_components, settle
from framewell.plans.joins import small
from framewell.plans.numbering import row_numbers
from framewell.session import materialise

#: Edges of a range that one task walks.
LEAF = 100_000


def merges(tree: DataFrame, points: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(rank, weight, x, nx, y, ny): the edges by (weight, a, b) with the names, x < y, and sizes of what they merge.

    points: (image_id, node), nodes numbered from 0; names are nodes.
    """
    many, edges = points.count(), row_numbers(tree, ["weight", "a", "b"], "rank")
    ends = points.select("image_id", "node")
    work = edges.join(ends.toDF("a", "_a"), "a").join(ends.toDF("b", "_b"), "b").select(F.lit(0).cast("long").alias("range"), "rank", "weight", F.col("_a").alias("a"), F.col("_b").alias("b"))
    work, nodes, width = materialise(work, "edges"), points.select(F.lit(0).cast("long").alias("range"), "node", F.lit(1).cast("long").alias("n")), leaf
    while width < many - 1:
        width *= 2
    code = lambda name: F.col("range") * many + F.col(name)
    while width > leaf:
        lower = F.col("rank") % width < width // 2
        low, high = work.filter(lower), work.filter(~lower)
        label = materialise(connected_components(low.select(code("a").alias("src"), code("b").alias("dst"))), "contracted")
        told = nodes.withColumn("code", code("node")).join(label.withColumnRenamed("node", "code"), "code", "left")
        told = materialise(told.select("range", "node", "n", "component"), "nodes")
        sizes = told.filter("component is not null").groupBy("range", (F.col("component") % many).alias("node")).agg(F.sum("n").alias("n"))
        # what a node of the upper half stands for: the lower half's component, or itself
        stands = told.select("range", F.col("node").alias("_of"), F.coalesce(F.col("component") % many, F.col("node")).alias("_to"))
        high = high.join(stands.toDF("range", "a", "_a"), ["range", "a"]).join(stands.toDF("range", "b", "_b"), ["range", "b"])
        high = materialise(high.select("range", "rank", "weight", F.col("_a").alias("a"), F.col("_b").alias("b")), "upper")
        alone = told.filter("component is null").select("range", "node", "n")
        used = high.select("range", F.col("a").alias("node")).union(high.select("range", "b")).distinct()
        above = alone.unionByName(sizes).join(used, ["range", "node"], "left_semi").select((F.col("range") * 2 + 1).alias("range"), "node", "n")
        nodes = materialise(told.filter("component is not null").select((F.col("range") * 2).alias("range"), "node", "n").unionByName(above), "nodes")
        work = materialise(low.withColumn("range", F.col("range") * 2).unionByName(high.withColumn("range", F.col("range") * 2 + 1)), "edges")
        width //= 2
    sized = work.join(nodes.toDF("range", "a", "na"), ["range", "a"]).join(nodes.toDF("range", "b", "nb"), ["range", "b"])

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        top: dict[int, int] = {}
        size: dict[int, int] = {}
        out: list[list[int]] = [[], [], [], []]

        def name(node: int) -> int:
            while top.get(node, node) != node:
                top[node] = top.get(top[node], top[node])
                node = top[node]
            return node

        for a, na, b, nb in zip(*(table.column(c).to_pylist() for c in ("a", "na", "b", "nb")), strict=True):
            size.setdefault(a, na)
            size.setdefault(b, nb)
            x, y = sorted((name(a), name(b)))
            for column, v in zip(out, (x, size[x], y, size[y]), strict=True):
                column.append(v)
            top[y] = x
            size[x] += size[y]
        return pa.table([table.column("rank"), table.column("weight"), *(pa.array(c, pa.int64()) for c in out)], names=["rank", "weight", "x", "nx", "y", "ny"])

    return materialise(sized.groupBy("range").applyInArrow(lambda table: walk(table), "rank long, weight double, x long, nx long, y long, ny long"), "merges")


def linked(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merges with the merges that made their sides, cx and cy, and that take their result in, parent; null where there
    is none; each node's first merge: (node, rank)).

    A name's merges are found one after the other by numbers over (name, rank), so a name with very many of them is no
    task of its own.
    """
    sides = steps.select("rank", F.col("x").alias("name")).unionByName(steps.select("rank", F.col("y").alias("name")))
    numbered = materialise(row_numbers(sides, ["name", "rank"]), "sides")
    before = numbered.select((F.col("number") + 1).alias("number"), F.col("name").alias("_name"), F.col("rank").alias("child"))
    after = numbered.select((F.col("number") - 1).alias("number"), F.col("name").alias("_next"), F.col("rank").alias("parent"))
    told = numbered.join(before, "number", "left").join(after, "number", "left")
    told = told.select("rank", "name", F.when(F.col("_name") == F.col("name"), F.col("child")).alias("child"), F.when(F.col("_next") == F.col("name"), F.col("parent")).alias("parent"))
    told = materialise(told, "sides")
    x = told.select("rank", F.col("name").alias("x"), F.col("child").alias("cx"), "parent")
    y = told.select("rank", F.col("name").alias("y"), F.col("child").alias("cy"))
    return steps.join(x, ["rank", "x"]).join(y, ["rank", "y"]), told.filter("child is null").select(F.col("name").alias("node"), "rank")


def masses(steps: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """((rank, cluster) of the big merges; (cluster, parent, left, right, mass): the tree of clusters, parent null at its
    root, left and right null where a cluster first came up). A weight of 0 counts as the smallest above it."""
    least = steps.filter("weight > 0").agg(F.min("weight").alias("w")).first()["w"]
    big = steps.filter(F.col("nx") + F.col("ny") >= size).withColumn("density", 1 / F.greatest("weight", F.lit(least)))
    bx, by = F.col("nx") >= size, F.col("ny") >= size
    chain = big.filter(bx != by).select(F.col("rank").alias("node"), F.when(bx, F.col("cx")).otherwise(F.col("cy")).alias("root"))
    bottoms = big.filter(bx == by)
    cluster = materialise(settle(chain).toDF("rank", "cluster").unionByName(bottoms.select("rank", F.col("rank").alias("cluster"))), "chains")
    of = cluster.select(F.col("rank").alias("_rank"), F.col("cluster").alias("_cluster"))
    splits = bottoms.filter(bx).select(F.col("rank").alias("parent"), "density", "cx", "cy")
    splits = splits.join(of.toDF("cx", "left"), "cx").join(of.toDF("cy", "right"), "cy")
    splits = materialise(splits.select("parent", "density", "left", "right"), "splits")
    born = splits.select(F.explode(F.array("left", "right")).alias("cluster"), "parent", F.col("density").alias("since"))
    born = materialise(bottoms.select(F.col("rank").alias("cluster")).join(born, "cluster", "left"), "born")
    gone = F.when(bx == by, F.col("nx") + F.col("ny")).otherwise(F.least("nx", "ny"))
    left = big.select("rank", "density", gone.alias("gone")).join(cluster, "rank").join(small(born.select("cluster", "since")), "cluster")
    mass = left.groupBy("cluster").agg(F.sum(F.col("gone") * (F.col("density") - F.coalesce("since", F.lit(0.0)))).alias("mass"))
    known = born.select("cluster", "parent").join(mass, "cluster").join(splits.select(F.col("parent").alias("cluster"), "left", "right"), "cluster", "left")
    return cluster, materialise(known.select("cluster", "parent", "left", "right", "mass"), "clusters")


def best_below(clusters: DataFrame) -> DataFrame:
    """(cluster, best): the larger of a cluster's mass and the sum of what is best in the two it splits into.

    todo 0: a is the result; 1: it is max(a, b + that of left); 2: max(a, that of left + that of right).
    """
    state = clusters.select("cluster", F.when(F.col("left").isNull(), 0).otherwise(2).alias("todo"), F.col("mass").alias("a"), F.lit(0.0).alias("b"), "left", "right")
    while not state.filter("todo > 0").isEmpty():
        one = state.select(F.col("cluster").alias("left"), F.struct("todo", "a", "b", "left").alias("l"))
        two = state.select(F.col("cluster").alias("right"), F.struct("todo", "a").alias("r"))
        both = state.join(one, "left", "left").join(two, "right", "left")
        l_known, r_known = F.col("l.todo") == 0, F.col("r.todo") == 0
        state = materialise(
            both.select(
                "cluster",
                F.expr("CASE WHEN todo = 0 THEN 0 WHEN todo = 1 THEN IF(l.todo = 0, 0, 1) WHEN l.todo = 0 AND r.todo = 0 THEN 0 WHEN l.todo = 0 OR r.todo = 0 THEN 1 ELSE 2 END AS todo"),
                F.expr("CASE WHEN todo = 1 AND l.todo < 2 THEN greatest(a, b + l.a) WHEN todo = 2 AND l.todo = 0 AND r.todo = 0 THEN greatest(a, l.a + r.a) ELSE a END AS a"),
                F.expr("CASE WHEN todo = 1 AND l.todo = 1 THEN b + l.b WHEN todo = 2 AND l.todo = 0 THEN l.a WHEN todo = 2 AND r.todo = 0 THEN r.a ELSE b END AS b"),
                F.when((F.col("todo") == 1) & (F.col("l.todo") == 1), F.col("l.left")).when((F.col("todo") == 2) & l_known & ~r_known, F.col("right")).otherwise(F.col("left")).alias("left"),
                F.when(F.col("todo") == 2, F.col("right")).alias("right"),
            ),
            "best",
        )
    return state.select("cluster", F.col("a").alias("best"))


def chosen_above(clusters: DataFrame, leaf: bool) -> DataFrame:
    """(cluster, chosen) of the clusters that are chosen or lie in one that is; the root is never chosen."""
    if leaf:
        good = clusters.select("cluster", "parent", F.col("left").isNull().alias("good"))
    else:
        best = best_below(clusters)
        told = clusters.join(best.toDF("left", "_l"), "left", "left").join(best.toDF("right", "_r"), "right", "left")
        good = told.select("cluster", "parent", (F.col("left").isNull() | (F.col("mass") >= F.col("_l") + F.col("_r"))).alias("good"))
    state = materialise(good.select("cluster", F.col("parent").alias("up"), F.when(F.col("good") & F.col("parent").isNotNull(), F.col("cluster")).alias("top")), "choice")
    while not state.filter("up is not null").isEmpty():  # each pass doubles how far up a cluster has looked
        above = state.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        state = materialise(state.join(above, "up", "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")), "choice")
    return state.filter("top is not null").select("cluster", F.col("top").alias("chosen"))


def hierarchy_labels(tree: DataFrame, rows: DataFrame, size: int, leaf: bool = False, edges_in_task: int = LEAF) -> DataFrame:
    """(image_id, cluster_id): -1 for noise, clusters from 1 by their smallest member.

    tree: (a, b, weight), a spanning tree of rows (image_id). size: members that make a cluster, 2 at least. leaf: choose
    the clusters that don't split instead. Where no edge is longer than 0, or there are too few rows, all is noise.
    """
    size, noise = max(2, size), rows.select("image_id", F.lit(-1).alias("cluster_id"))
    if tree.filter("weight > 0").isEmpty() or rows.limit(size).count() < size:
        return noise
    points = materialise(row_numbers(rows.select("image_id"), ["image_id"], "node"), "points")
    steps, first = linked(merges(tree, points, edges_in_task))
    steps = materialise(steps, "steps")
    cluster, clusters = masses(steps, size)
    chosen = chosen_above(clusters, leaf)
    # a point's place is the first big merge above it
    climb = settle(steps.filter((F.col("nx") + F.col("ny") < size) & F.col("parent").isNotNull()).select(F.col("rank").alias("node"), F.col("parent").alias("root")))
    place = first.join(climb.toDF("rank", "_big"), "rank", "left").select("node", F.coalesce("_big", "rank").alias("rank"))
    told = materialise(place.join(cluster, "rank").join(chosen, "cluster").select("node", "chosen"), "told")
    names = row_numbers(told.groupBy("chosen").agg(F.min("node").alias("first")), ["first"]).select("chosen", (F.col("number") + 1).cast("int").alias("cluster_id"))
    labels = told.join(small(materialise(names, "names")), "chosen").select("node", "cluster_id")
    return points.join(labels, "node", "left").select("image_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
