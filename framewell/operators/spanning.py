"""A minimum spanning tree under mutual reachability, over the blocks of a metric partition.

Rounds join each component to what is nearest to it (ties by weight, then by the ends, so all edges differ). Candidate
edges are kept from round to round: at first each row's nearest neighbours, later also what searches found. A row knows
its floor, which no edge that isn't a candidate lies below. So a component's best candidate is its nearest edge unless
the floor of some of its rows, its border, is no higher; only the border searches, no farther than that candidate, among
blocks whose bound allows it and that hold other components. The largest component doesn't search, the others come to
it, so what is searched gets less from round to round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.operators.neighbours import knn_join
from framewell.plans.components import connected_components
from framewell.plans.joins import small
from framewell.plans.pivots import BLOCK, SLACK, all_with_all, choose_pivots, distances, pair_distances, partition, squared, unpack, within
from framewell.session import materialise

#: Neighbours of a row that are candidates at first.
NEAR = 12
#: Rows whose components are broadcast at most in a search; those of more are joined.
BROADCAST = 1 << 20
EDGE = ("weight", "a", "b")


class _NearestOfOthers:
    """The least edge of each row of a block's border to another component, of those met so far."""

    def __init__(self, q: dict):
        self.q, self.most, self.lost = q, q["most"].copy(), np.iinfo(np.int64).max
        self.weight = np.full(len(self.most), np.inf)
        self.a, self.b = np.full(len(self.most), self.lost), np.full(len(self.most), self.lost)

    def meet(self, t: dict, component: np.ndarray) -> None:
        q = self.q
        apart = (q["component"][:, None] != component[None, :]) & (t["core"][None, :] <= self.most[:, None])
        table = squared(q["vector"], t["vector"])
        if table is not None:
            far, off, scale = table
            up = np.sqrt(np.maximum(far + off[:, None], 0)) * (scale * (1 + SLACK))  # no less than the distance
            np.maximum(up, t["core"][None, :], out=up)
            np.maximum(up, q["core"][:, None], out=up)
            up[~apart] = np.inf
            most = np.minimum(self.most, up.min(axis=1, initial=np.inf))
            apart &= within(table, most)
        else:
            most = self.most
        i, j = np.divmod(np.flatnonzero(apart), apart.shape[1])
        weight = np.maximum(pair_distances(q["vector"], t["vector"], i, j), np.maximum(q["core"][i], t["core"][j]))
        near = (weight <= most[i]) & np.isfinite(weight)
        i, j, weight = i[near], j[near], weight[near]
        a, b = np.minimum(q["image_id"][i], t["image_id"][j]), np.maximum(q["image_id"][i], t["image_id"][j])
        i, weight, a, b = (np.concatenate(c) for c in ((i, np.arange(len(most))), (weight, self.weight), (a, self.a), (b, self.b)))
        order = np.lexsort((b, a, weight, i))
        first = order[np.searchsorted(i[order], np.arange(len(most)))]
        self.weight, self.a, self.b = weight[first], a[first], b[first]
        self.most = np.minimum(self.most, self.weight)

    def found(self) -> pa.RecordBatch:
        on = np.isfinite(self.weight)
        return pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (self.q["image_id"], self.q["component"], self.weight, self.a, self.b)], names=["image_id", "component", *EDGE])


def core_distances(near: DataFrame, k: int) -> DataFrame:
    """(image_id, core) from neighbours of all rows, each row being its own first: the distance to the k-th."""
    return near.filter(F.col("rank") <= k).groupBy(F.col("query_id").alias("image_id")).agg(F.max("distance").alias("core"))


def reachable(near: DataFrame, cores: DataFrame) -> DataFrame:
    """near with `reach`: no less than the distance or either core distance."""
    a, b = cores.select(F.col("image_id").alias("query_id"), F.col("core").alias("_a")), cores.select("image_id", F.col("core").alias("_b"))
    return near.join(a, "query_id").join(b, "image_id").withColumn("reach", F.greatest("distance", "_a", "_b")).drop("_a", "_b")


def spanning_tree(vectors: DataFrame, cores: DataFrame, near: DataFrame | None = None, block: int = BLOCK, rounds: list | None = None) -> DataFrame:
    """(a, b, weight), a < b: the minimum spanning tree, ties by (weight, a, b). Fewer than two rows have no edge.

    near: the nearest neighbours of every row (query_id, image_id, distance, rank), itself included, as many for each;
    NEAR are searched where it is not given. rounds: gets a dict of counts for each round (which costs a few jobs).
    """
    spark, n = vectors.sparkSession, vectors.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long, weight double")
    near = materialise(knn_join(vectors, vectors, NEAR, block=block), "near") if near is None else near
    pivots = choose_pivots(vectors, n, block)
    index = partition(vectors.join(cores, "image_id"), pivots, n, block, ("core",))
    known = index.without_rows()
    numbers = {int(b): k for k, b in enumerate(index.numbers)}
    rows = index.rows.select("block", F.inline("rows")).select("block", "number", "image_id", "core")
    core = {r["block"]: r["low"] for r in rows.groupBy("block").agg(F.min("core").alias("low")).collect()}  # one a block
    least_core = np.array([core[int(b)] for b in index.numbers])
    reps = materialise(index.rows.select("block", F.expr("rows[0]").alias("r")).select(F.expr(f"block % {len(pivots)}").alias("pivot"), "r.*").groupBy("pivot").agg(F.min_by(F.struct("image_id", "vector", "core"), "number").alias("r")).select("r.*"), "reps")

    listed = near.groupBy(F.col("query_id").alias("image_id")).agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
    floor = F.when(F.col("_n") >= n, F.lit(float("inf"))).otherwise(F.greatest("_far", "core"))
    label = materialise(rows.join(listed, "image_id").select("image_id", "block", "number", F.col("image_id").alias("component"), floor.alias("floor")), "label")
    edges = reachable(near.filter("query_id <> image_id"), cores).select(F.least("query_id", "image_id").alias("a"), F.greatest("query_id", "image_id").alias("b"), F.col("reach").alias("weight")).distinct()
    tree = None
    while True:
        ends = label.select("image_id", "component")
        between = edges.join(ends.toDF("a", "ca"), "a").join(ends.toDF("b", "cb"), "b").filter("ca <> cb")
        between = materialise(between.select("a", "b", "weight", "ca", "cb"), "between")
        sizes = label.groupBy("component").agg(F.count("*").alias("n"))
        largest = sizes.orderBy(F.desc("n"), "component").limit(1).collect()[0]
        if largest["n"] == n:
            return tree
        either = between.select(F.col("ca").alias("component"), "weight", "a", "b").unionByName(between.select(F.col("cb").alias("component"), "weight", "a", "b"))
        best = materialise(either.filter(F.col("component") != largest["component"]).groupBy("component").agg(F.min(F.struct(*EDGE)).alias("e")), "best")
        told = label.filter(F.col("component") != largest["component"]).join(small(best), "component", "left")
        most = F.coalesce(F.col("e.weight"), F.lit(float("inf")))
        border = materialise(told.filter(F.col("floor") <= most).select("image_id", "block", "number", "component", most.alias("most")), "border")
        found, met = _search(index, known, numbers, least_core, pivots, label, border, reps, n)
        if rounds is not None:
            rounds.append({"components": sizes.count(), "candidates": between.count(), "searching": border.count(), "blocks_met": met.count() if met is not None else 0, "blocks": len(numbers)})
        if found is not None:
            floors = border.join(found.select("image_id", "weight"), "image_id", "left").select("image_id", F.coalesce("weight", "most").alias("_floor"))
            label = label.join(floors, "image_id", "left").select("image_id", "block", "number", "component", F.coalesce("_floor", "floor").alias("floor"))
            best = best.unionByName(found.groupBy("component").agg(F.min(F.struct(*EDGE)).alias("e")))
            between = between.select("a", "b", "weight").unionByName(found.select("a", "b", "weight")).distinct()
        new = materialise(best.groupBy("component").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.weight").distinct(), "tree")
        tree = new if tree is None else tree.unionByName(new)
        joined = new.join(ends.toDF("a", "src"), "a").join(ends.toDF("b", "dst"), "b")
        merged = materialise(connected_components(joined.select("src", "dst")).select(F.col("node").alias("component"), F.col("component").alias("_to")), "merged")
        label = materialise(label.join(small(merged), "component", "left").select("image_id", "block", "number", F.coalesce("_to", "component").alias("component"), "floor"), "label")
        edges = between.select("a", "b", "weight")


def _search(index, known, numbers, least_core, pivots, label, border, reps, n) -> tuple[DataFrame | None, DataFrame | None]:
    """(image_id, component, weight, a, b): the nearest row of another component of each row of the border, if it is no
    farther than `most`; and the pairs of blocks that met."""
    if border.isEmpty():
        return None, None
    state = label.join(border.select("image_id", "most"), "image_id", "left").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("number", "component", F.coalesce("most", F.lit(-1.0)).alias("most")))).alias("state"))
    state = materialise(state, "state")
    spans = state.select("block", F.array_min("state.component").alias("low"), F.array_max("state.component").alias("high")).collect()  # one a block
    alone = np.full(len(numbers), -1, np.int64)
    single = np.zeros(len(numbers), bool)
    for r in spans:
        alone[numbers[r["block"]]], single[numbers[r["block"]]] = r["low"], r["low"] == r["high"]
    some = reps.join(label.select("image_id", "component"), "image_id").orderBy("image_id").collect()  # one a pivot
    rep_vectors, rep_core, rep_component = (np.array([r[c] for r in some]) for c in ("vector", "core", "component"))

    def plan(batches):
        for b in batches:
            blocks, rows, others = [], [], []
            for number, cell, state_cell in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                q, s = unpack(cell), unpack(state_cell)
                most, on = s["most"].copy(), np.flatnonzero(s["most"] >= 0)
                wanted = np.zeros(len(numbers), bool)
                step = max(1, (1 << 22) // len(numbers))
                for some in np.split(on, range(step, len(on), step)):
                    lost = some[np.isinf(most[some])]  # no candidate: the pivots' own rows are some
                    if len(lost):
                        reach = np.maximum(distances(q["vector"][lost], rep_vectors), np.maximum(q["core"][lost][:, None], rep_core[None, :]))
                        reach[s["component"][lost][:, None] == rep_component[None, :]] = np.inf
                        most[lost] = reach.min(axis=1)
                    bound = np.maximum(known.bounds(distances(q["vector"][some], pivots)), np.maximum(q["core"][some][:, None], least_core[None, :]))
                    own = single[None, :] & (alone[None, :] == s["component"][some][:, None])
                    wanted |= ((bound <= most[some][:, None]) & ~own).any(axis=0)
                blocks.append(number)
                rows.append([q["image_id"][on], s["component"][on], most[on], q["core"][on], q["vector"][on]])
                others.append(known.numbers[wanted])
            if not blocks:
                continue
            *columns, vectors = (np.concatenate(c) for c in zip(*rows, strict=True))
            ends = np.arange(len(vectors) + 1, dtype=np.int32)
            columns = [*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends * vectors.shape[1]), pa.array(vectors.ravel()))]
            asked = pa.StructArray.from_arrays(columns, names=["image_id", "component", "most", "core", "vector"])
            starts = np.cumsum([0, *(len(r[0]) for r in rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.ListArray.from_arrays(pa.array(starts), asked), pa.array(others, pa.list_(pa.int64()))], names=["block", "asked", "others"])

    def meet(batches):
        held, block = None, None
        for b in batches:
            for number, mine, theirs, other_cell in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
                if number != block:
                    if held is not None:
                        yield held.found()
                    held, block = _NearestOfOthers(unpack(mine)), number
                held.meet(unpack(theirs), other_cell.values.to_numpy())
        if held is not None:
            yield held.found()

    asking = small(materialise(border.select("block").distinct(), "asking"))
    told = F.broadcast(state) if n <= BROADCAST else state
    asked = "asked array<struct<image_id:long,component:long,most:double,core:double,vector:array<double>>>"
    plans = materialise(index.rows.join(asking, "block", "left_semi").join(told, "block").select("block", "rows", "state").mapInArrow(plan, f"block long, {asked}, others array<long>"), "plans")
    theirs = index.rows.join(told, "block").select(F.col("block").alias("other"), F.col("rows").alias("theirs"), F.col("state.component").alias("their_component"))
    met = all_with_all(plans, theirs, n * (pivots.shape[1] + 8) * 8, F.array_contains("others", F.col("other")))
    near = met.select("block", "asked", "theirs", "their_component").mapInArrow(meet, "image_id long, component long, weight double, a long, b long")
    found = near.groupBy("image_id", "component").agg(F.min(F.struct(*EDGE)).alias("e")).select("image_id", "component", "e.*")
    return materialise(found, "found"), plans.select("block", F.explode("others").alias("other"))
