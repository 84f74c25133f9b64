"""A layout of vectors in few dimensions that is learned from who is near whom.

The graph of nearest neighbours gets weights that fall with the distance, each row's distances told by that to its own
k-th neighbour. Its random walk, lazy by a half, is applied to the leading principal components, STEPS times, and the
directions of the result that the walk shrinks least (of those that are not the same everywhere) are the layout: a block
power iteration for the leading eigenvectors that begins where the plain reduction ends. A step is one join and one sum
over rows of edges. What comes to the driver are two matrices of as many rows as the block has columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.config import CONFIG
from framewell.functions.vectors import l2_normalised
from framewell.operators.neighbours import knn_join
from framewell.plans.joins import skew_join
from framewell.session import materialise, release

#: Neighbours of a row, columns of the block beyond those asked for, and steps.
NEAR, SPARE, STEPS = 20, 5, 10
#: Rows whose columns of the block are broadcast at most in a step; more are joined.
BROADCAST = 50_000
#: The smallest weight of an edge, so that a row among many copies stays linked.
LEAST = 1e-6


def neighbour_graph(near: DataFrame) -> DataFrame:
    """(a, b, weight), each edge in both directions, of neighbours (query_id, image_id, distance), no row being its own."""
    far = near.groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    scale = materialise(far, "scale")
    # a row may be the neighbour of very many
    asked = near.groupBy("image_id").agg(F.count("*").alias("_rows")).join(scale.select(F.col("query_id").alias("image_id"), F.col("far").alias("_b")), "image_id")
    rows = skew_join(near, asked, "image_id", "_rows").join(scale.select("query_id", F.col("far").alias("_a")), "query_id")
    tiny = F.lit(1e-24)
    weight = F.greatest(F.exp(-F.col("distance") * F.col("distance") / F.greatest(F.col("_a") * F.col("_b"), tiny)), F.lit(LEAST))
    edges = rows.select(F.least("query_id", "image_id").alias("a"), F.greatest("query_id", "image_id").alias("b"), weight.alias("weight"))
    one = edges.groupBy("a", "b").agg(F.max("weight").alias("weight"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def lazy_walk(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, weight): half the identity and half the graph divided by the roots of both ends' degrees; (image_id, root,
    edges): the root of each row's degree, and how many rows of the first it has)."""
    degree = graph.groupBy(F.col("a").alias("image_id")).agg(F.sqrt(F.sum("weight")).alias("root"), (F.count("*") + 1).alias("edges"))
    degree = materialise(degree, "degree")
    half = graph
    for end, name in (("a", "_ra"), ("b", "_rb")):
        half = skew_join(half, degree.select(F.col("image_id").alias(end), F.col("root").alias(name), "edges"), end, "edges")
    half = half.select("a", "b", (F.col("weight") / (2 * F.col("_ra") * F.col("_rb"))).alias("weight"))
    stays = degree.select(F.col("image_id").alias("a"), F.col("image_id").alias("b"), F.lit(0.5).alias("weight"))
    return materialise(half.unionByName(stays), "walk"), degree


def _stepped(walk: DataFrame, state: DataFrame, columns: list[str], few: bool) -> DataFrame:
    """state (image_id, edges, columns) after a step of the walk. few: it has BROADCAST rows at most."""
    told = state.withColumnRenamed("image_id", "b")
    met = walk.join(F.broadcast(told.drop("edges")), "b") if few else skew_join(walk, told, "b", "edges")
    return met.groupBy(F.col("a").alias("image_id")).agg(F.count("*").alias("edges"), *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns])


def _products(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Products of columns, summed over all rows: one small matrix a task, added up in the tasks' order."""

    def run(batches):
        total = np.zeros((len(left), len(right)))
        for b in batches:
            m = np.column_stack([c.to_numpy() for c in b.columns])
            total += m[:, : len(left)].T @ m[:, len(left) :]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.select(*[F.col(c).alias(f"x{k}") for k, c in enumerate([*left, *right])]).mapInArrow(run, "sums array<double>")
    sums = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(len(left) * len(right))
    for r in sums.collect():  # one a cell
        out[r["at"]] = r["v"]
    return out.reshape(len(left), len(right))


def leading(block: np.ndarray, stepped: np.ndarray, components: int) -> np.ndarray:
    """Weights of the block's columns, a column a direction, in falling order of what the walk leaves of each.

    block: products of the block's columns; stepped: products with the columns after a step. The first column is the
    direction in which the walk tells nobody apart: what the others have of it is taken off. Directions that rounding
    alone tells apart are zero.
    """
    n = len(block)
    off = np.eye(n)[:, 1:]
    off[0] = -block[0, 1:] / block[0, 0]
    gram, moved = off.T @ block @ off, off.T @ ((stepped + stepped.T) / 2) @ off
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    values, vectors = np.linalg.eigh(gram / np.outer(size, size))
    kept = values > 1e-10
    white = vectors[:, kept] / np.sqrt(values[kept]) / size[:, None]
    shrunk, turn = np.linalg.eigh(white.T @ moved @ white)
    found = (white @ turn)[:, np.argsort(-shrunk, kind="stable")[:components]]
    found = found * np.where(found[np.abs(found * size[:, None]).argmax(axis=0), np.arange(found.shape[1])] < 0, -1, 1)
    return np.pad(off @ found, ((0, 0), (0, components - found.shape[1])))


def learned_layout(vectors: DataFrame, components: int = CONFIG.reduce_to, k: int = NEAR, steps: int = STEPS, near: DataFrame | None = None) -> DataFrame:
    """(image_id, vector) in so many dimensions, about as far from their centre as unit vectors are; the same for every
    run up to rounding.

    Vectors are compared by angle. Sets of no more rows than the block has columns get their principal components. near:
    (query_id, image_id, distance) of the k nearest other rows of each, where they are known already or an approximate
    search is enough; the exact search meets all blocks with all if the vectors have no structure. Null vectors have no
    row in the result.
    """
    from framewell.operators.cluster import reduced

    rows = materialise(vectors.filter("vector is not null").select("image_id", l2_normalised(F.col("vector")).alias("vector")), "unit")
    head = rows.select(F.size("vector").alias("d")).first()
    if head is None:
        return rows
    block = min(components + SPARE, head["d"])
    n = rows.count()
    if n <= block + 1 or block < components:
        return reduced(rows, min(components, head["d"]))
    near = materialise(knn_join(rows, rows, min(k, n - 1), itself=False) if near is None else near, "near")
    walk, degree = lazy_walk(neighbour_graph(near))
    start = reduced(rows, block)
    middle = start.agg(*[F.avg(F.col("vector")[j]).alias(f"m{j}") for j in range(block)]).first()
    columns = [f"y{j}" for j in range(block + 1)]
    first = [(F.col("vector")[j] - F.lit(middle[j])) * F.col("root") for j in range(block)]
    state = degree.join(start, "image_id").select("image_id", "edges", F.col("root").alias("y0"), *[c.alias(f"y{j + 1}") for j, c in enumerate(first)])
    for _ in range(steps):
        state = _stepped(walk, state, columns, n <= BROADCAST)
        if n > BROADCAST:  # each step is written before the next one reads it
            release(rows.sparkSession)
    state = materialise(state, "stepped")
    after = _stepped(walk, state, columns, n <= BROADCAST).drop("edges")
    both = state.join(after.toDF("image_id", *[f"_{c}" for c in columns]), "image_id")
    weights = leading(_products(state, columns, columns), _products(both, columns, [f"_{c}" for c in columns]), components)
    place = [sum((F.col(c) * float(w) for c, w in zip(columns, weights[:, j], strict=True)), F.lit(0.0)) / F.col("root") for j in range(components)]
    out = materialise(state.join(degree.select("image_id", "root"), "image_id").select("image_id", F.array(*place).alias("vector")), "layout")
    centre = out.agg(*[F.avg(F.col("vector")[j]).alias("m") for j in range(components)], *[F.avg(F.col("vector")[j] * F.col("vector")[j]).alias("s") for j in range(components)]).first()
    spread = sum(max(centre[components + j] - centre[j] ** 2, 0.0) for j in range(components)) ** 0.5 or 1.0
    return out.select("image_id", F.array(*[(F.col("vector")[j] - F.lit(centre[j])) / F.lit(spread) for j in range(components)]).alias("vector"))
