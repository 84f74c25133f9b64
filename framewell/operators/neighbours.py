"""Nearest neighbours by a metric partition, and the votes over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.config import CONFIG
from framewell.plans.pivots import BLOCK, SLACK, Blocks, all_with_all, choose_pivots, distances, pair_distances, partition, squared, unpack, within
from framewell.session import materialise


@dataclass
class Meetings:
    """Which blocks of queries have to meet which blocks of training rows, with what each query knows by then."""

    queries: DataFrame  # (block, rows, reach, others): reach, a number a query, is no less than its k-th distance
    train: Blocks
    pairs: DataFrame  # (block, other)
    possible: int
    size: int  # bytes of the training rows

    def share(self) -> float:
        """Share of all pairs of blocks that meet."""
        return self.pairs.count() / self.possible if self.possible else 0.0


def meetings(queries: DataFrame, train: DataFrame, k: int = CONFIG.knn, itself: bool = True, block: int = BLOCK) -> Meetings | None:
    """Plan of an exact search; None if either side is empty.

    Each block of queries first meets one block near to it, which bounds the k-th distance of each of its queries. Then
    it has to meet the blocks that may hold a row no farther than that.
    """
    queries, train = queries.select("image_id", "vector"), train.select("image_id", "vector")
    n_train, n_queries = train.count(), queries.count()
    if not n_train or not n_queries:
        return None
    pivots = choose_pivots(train, n_train, block)
    found = partition(train, pivots, n_train, block)
    asked = found if queries.sameSemantics(train) else partition(queries, pivots, n_queries, block)
    known, least = found.without_rows(), k if itself else k + 1

    def home(batches):
        full = np.flatnonzero(known.n >= least)
        for b in batches:
            out = []
            for cell in b.column(1):
                x = unpack(cell)["vector"]
                far = known.bounds(distances(x[:: max(1, len(x) // 64)], pivots)).mean(axis=0)  # where to look first is a guess
                out.append(int(known.numbers[full[far[full].argmin()] if len(full) else known.n.argmax()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["block", "other"])

    def farthest(q: dict, t: dict) -> np.ndarray:
        """No less than the k-th distance of each query among t."""
        if len(t["vector"]) < k:
            return np.full(len(q["vector"]), np.inf)
        table = squared(q["vector"], t["vector"])
        far = distances(q["vector"], t["vector"]) if table is None else table[0]
        if not itself:
            far[q["image_id"][:, None] == t["image_id"][None, :]] = np.inf
        low = np.partition(far, k - 1, axis=1)[:, k - 1]
        return low if table is None else np.sqrt(np.maximum(low.astype(np.float64) + table[1], 0)) * table[2] * (1 + SLACK)

    def wanted(x: np.ndarray, reach: np.ndarray) -> list[int]:
        """The blocks that may hold a row no farther than a query's reach."""
        on = np.zeros(len(known.numbers), bool)
        step = max(1, (1 << 22) // len(on))
        for at in range(0, len(x), step):
            on |= (known.bounds(distances(x[at : at + step], pivots)) <= reach[at : at + step, None]).any(axis=0)
        return known.numbers[on].tolist()

    def reached(batches):
        for b in batches:
            out, others = [], []
            for mine, theirs in zip(b.column(1), b.column(2), strict=True):
                q = unpack(mine)
                out.append(farthest(q, unpack(theirs)))
                others.append(wanted(q["vector"], out[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64())), pa.array(others, pa.list_(pa.int64()))], names=["block", "rows", "reach", "others"])

    theirs = found.rows.select(F.col("block").alias("other"), F.col("rows").alias("theirs"))
    kind = asked.rows.schema["rows"].dataType.simpleString()
    first = asked.rows.mapInArrow(home, "block long, other long").join(asked.rows, "block").join(theirs, "other").select("block", "rows", "theirs")
    told = materialise(first.mapInArrow(reached, f"block long, rows {kind}, reach array<double>, others array<long>"), "reach")
    pairs = told.select("block", F.explode("others").alias("other"))
    return Meetings(told, found, pairs, len(asked.numbers) * len(found.numbers), n_train * (pivots.shape[1] + 8) * 8)


class _Nearest:
    """The k nearest rows of each query of a block, of those met so far: by (distance, id)."""

    def __init__(self, q: dict, reach: np.ndarray, k: int, itself: bool):
        self.q, self.most, self.k, self.itself = q, reach.copy(), k, itself
        self.far, self.ids = np.full((len(reach), k), np.inf), np.full((len(reach), k), np.iinfo(np.int64).max)

    def meet(self, t: dict) -> None:
        q, k = self.q, self.k
        table = squared(q["vector"], t["vector"])
        hit = distances(q["vector"], t["vector"]) <= self.most[:, None] if table is None else within(table, self.most)
        if not self.itself:
            hit &= q["image_id"][:, None] != t["image_id"][None, :]
        i, j = np.divmod(np.flatnonzero(hit), hit.shape[1])
        far = pair_distances(q["vector"], t["vector"], i, j)
        near = (far <= self.most[i]) & np.isfinite(far)
        i, far, ids = i[near], far[near], t["image_id"][j[near]]
        if not len(i):
            return
        rows = np.unique(i)
        i, far, ids = (np.concatenate(c) for c in ((i, np.repeat(rows, k)), (far, self.far[rows].ravel()), (ids, self.ids[rows].ravel())))
        order = np.lexsort((ids, far, i))
        first = order[np.searchsorted(i[order], rows)[:, None] + np.arange(k)]
        self.far[rows], self.ids[rows] = far[first], ids[first]
        self.most = np.minimum(self.most, self.far[:, -1])

    def found(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.far))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.q["image_id"][row], self.ids[row, place], self.far[row, place])], names=["query_id", "image_id", "distance"])


def knn_join(queries: DataFrame, train: DataFrame, k: int = CONFIG.knn, itself: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, image_id, distance, rank): the k nearest training rows of each query, ties by id; exact.

    Blocks of queries meet the blocks of training rows that may hold one of the k, two at a time in a task, and leave k
    rows a query and part of the training rows at most, so neither side is held whole anywhere, nor copied for each block
    it meets. itself: whether a row may be its own neighbour.
    """
    plan = meetings(queries, train, k, itself, block)
    if plan is None:
        return queries.sparkSession.createDataFrame([], "query_id long, image_id long, distance double, rank int")
    theirs = plan.train.rows.select(F.col("block").alias("other"), F.col("rows").alias("theirs"))
    met = all_with_all(plan.queries, theirs, plan.size, F.array_contains("others", F.col("other")))

    def run(batches):
        held, block = None, None
        for b in batches:
            for number, mine, reach, other in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
                if number != block:
                    if held is not None:
                        yield held.found()
                    held, block = _Nearest(unpack(mine), reach.values.to_numpy(), k, itself), number
                held.meet(unpack(other))
        if held is not None:
            yield held.found()

    some = met.select("block", "rows", "reach", "theirs").mapInArrow(run, "query_id long, image_id long, distance double")
    turn = Window.partitionBy("query_id").orderBy("distance", "image_id")
    return some.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, cluster_id, votes): the most frequent label among the neighbours, the smallest on ties."""
    counted = neighbours.join(labels.select("image_id", "cluster_id"), "image_id").groupBy("query_id", "cluster_id").agg(F.count("*").alias("votes"))
    best = counted.groupBy("query_id").agg(F.min(F.struct(-F.col("votes"), F.col("cluster_id"))).alias("b"))
    return best.select("query_id", F.col("b.cluster_id").alias("cluster_id"), (-F.col("b.col1")).alias("votes"))


def noise_rescue(vectors: DataFrame, clusters: DataFrame, k: int = CONFIG.knn, farthest: float = CONFIG.noise_distance, share: float = CONFIG.noise_share) -> DataFrame:
    """clusters with noise given the label most of its k nearest labelled rows have, if the nearest is close enough.

    Nothing changes unless noise is over `share` of all rows. Labels above 0 vote.
    """
    n = clusters.agg(F.count("*").alias("n"), F.count(F.when(F.col("cluster_id") == -1, 1)).alias("noise")).first()
    if not n["n"] or n["noise"] / n["n"] <= share:
        return clusters
    told = vectors.join(clusters.select("image_id", "cluster_id"), "image_id")
    near = knn_join(told.filter("cluster_id = -1"), told.filter("cluster_id > 0"), k)
    near = materialise(near, "near")
    close = near.filter((F.col("rank") == 1) & (F.col("distance") <= farthest)).select("query_id")
    new = vote(near.join(close, "query_id", "left_semi"), clusters).select(F.col("query_id").alias("image_id"), F.col("cluster_id").alias("_new"))
    return clusters.join(new, "image_id", "left").withColumn("cluster_id", F.coalesce("_new", "cluster_id")).drop("_new")


def knn_rescue(vectors: DataFrame, labels: DataFrame, saved: DataFrame, exclude: int, k: int = CONFIG.knn) -> DataFrame:
    """(image_id, cluster_id) voted for the saved rows among labels above 0 other than `exclude`; none where no row may vote."""
    train = vectors.join(labels.filter((F.col("cluster_id") > 0) & (F.col("cluster_id") != exclude)).select("image_id"), "image_id", "left_semi")
    near = knn_join(vectors.join(saved.select("image_id"), "image_id", "left_semi"), train, k)
    return vote(near, labels).select(F.col("query_id").alias("image_id"), "cluster_id")
