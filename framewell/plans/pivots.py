"""A metric partition: rows dealt to their nearest pivots, in blocks that know how near and how far their rows are.

A block is a run of the rows of one pivot by their distance to it. The triangle inequality then gives, from the distances
of a query to the pivots alone, a bound that no row of a block is nearer than, so a search meets few blocks if the
vectors have clusters or few dimensions, and all of them in the worst case. Pivots are a bounded sample (PIVOTS), used
only to cut the search, never to leave a row out; blocks grow once there would be more than BLOCKS, so what is known of
them is bounded and every task can hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.plans.numbering import row_numbers
from framewell.session import materialise

#: Rows in a block, unless there are too many blocks.
BLOCK = 2048
PIVOTS, BLOCKS = 4096, 65_536
#: Share of a distance that a bound may be off by rounding.
SLACK = 1e-6
#: Pairs whose distances are told in one step; bytes of a side that a task holds.
PAIRS, PART = 1 << 15, 48 << 20


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, row by row of a, from differences, so that equal vectors are at 0."""
    out = np.empty((len(a), len(b)))
    for k, row in enumerate(a):
        out[k] = np.sqrt(((b - row) ** 2).sum(axis=1))
    return out


def squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(distances, off, scale): squared distances in units of scale squared, row by row of a, by one product of matrices
    in single precision, and how far those of each row may be off. None where a number is not finite."""
    with np.errstate(invalid="ignore", over="ignore"):
        centre = b.mean(axis=0)
        x, y = a - centre, b - centre
        scale = float(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))) or 1.0
    if not np.isfinite(scale):
        return None
    x, y = (x / scale).astype(np.float32), (y / scale).astype(np.float32)
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    out = x @ y.T
    out *= -2
    out += xx[:, None]
    out += yy
    # four times what rounding of products of so many terms, and of the numbers themselves, can make of it
    return out, 4 * (a.shape[1] + 16) * 2.0**-23 * (xx.astype(np.float64) + yy.max(initial=0)) + 1e-30, scale


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of a to rows j of b, the same as `distances` gives."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        some = slice(at, at + PAIRS)
        out[some] = np.sqrt(((b[j[some]] - a[i[some]]) ** 2).sum(axis=1))
    return out


def within(table: tuple[np.ndarray, np.ndarray, float], most: np.ndarray) -> np.ndarray:
    """Which pairs of the table that `squared` gave may be no farther than `most`, a number a row."""
    far, off, scale = table
    limit = ((most / scale) ** 2 * (1 + SLACK) + off).astype(np.float32)
    return far <= np.nextafter(limit, np.float32(np.inf))[:, None]


def all_with_all(left: DataFrame, right: DataFrame, size: int, condition) -> DataFrame:
    """left and right joined on a condition that is no equality, neither of them copied for the other.

    Each task reads one part of either side, a row of left with all of right's part before the next one. size: bytes of
    right; a task holds a part of PART of them.
    """
    parts = max(1, -(-size // PART))
    tasks = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts)
    return left.repartition(tasks).hint("shuffle_replicate_nl").join(right.repartition(parts), condition)


def unpack(cell: pa.ListScalar) -> dict[str, np.ndarray]:
    """A block's rows as arrays by field; lists of numbers of one length become matrices."""
    rows, out = cell.values, {}
    for f in rows.type:
        column = rows.field(f.name)
        if pa.types.is_list(f.type):
            out[f.name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        else:
            out[f.name] = column.to_numpy(zero_copy_only=False)
    return out


@dataclass
class Blocks:
    """rows: (block, rows), rows being structs of number, image_id, vector and more, by number. Arrays by block: which
    pivot, distance of the nearest and of the farthest row to it, rows."""

    rows: DataFrame
    numbers: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """No row of a block is nearer to a query than this: queries x blocks, from the queries' distances to the pivots."""
        to = to_pivots[:, self.pivot]
        near = to_pivots.min(axis=1, keepdims=True)
        bound = np.maximum(np.maximum(to - self.high, self.low - to), (to - near) / 2)
        return np.nan_to_num(np.maximum(bound - SLACK * (to + self.high), 0), nan=0, posinf=np.inf)  # a row that isn't finite bounds nothing

    def without_rows(self) -> Blocks:
        return Blocks(None, self.numbers, self.pivot, self.low, self.high, self.n)


def choose_pivots(vectors: DataFrame, n: int, block: int = BLOCK) -> np.ndarray:
    """About one pivot a block, PIVOTS at most: the rows whose ids have the smallest hashes."""
    rows = vectors.select("vector").orderBy(F.xxhash64("image_id"), "image_id").limit(min(PIVOTS, max(1, n // block)))
    some = np.unique(np.array([r["vector"] for r in rows.collect()], np.float64), axis=0)
    finite = some[np.isfinite(some).all(axis=1)]
    return finite if len(finite) else some


def partition(vectors: DataFrame, pivots: np.ndarray, n: int, block: int = BLOCK, more: tuple[str, ...] = ()) -> Blocks:
    """The n rows (image_id, vector and `more`) in blocks of about `block` rows each, written once.

    Rows are numbered by ranges of (pivot, distance, id), so one pivot with most of the rows, or one vector that very
    many rows have, makes more blocks, not larger ones.
    """
    size = max(block, -(-n // BLOCKS))
    named = vectors.select("image_id", F.col("vector").cast("array<double>").alias("vector"), *more)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields)

    def run(batches):
        for b in batches:
            rows = b.column(1)
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.empty((0, pivots.shape[1]))
            far = distances(x, pivots)
            nearest = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest, pa.int64()), pa.array(far[np.arange(len(x)), nearest], pa.float64())], names=[*b.schema.names, "pivot", "radius"])

    numbered = row_numbers(named.mapInArrow(run, f"{fields}, pivot long, radius double"), ["pivot", "radius", "image_id"])
    code = F.floor(F.col("number") / size).cast("long") * len(pivots) + F.col("pivot")
    held = F.array_sort(F.collect_list(F.struct("number", "image_id", "vector", *more))).alias("rows")
    grouped = numbered.groupBy(code.alias("block"), "pivot").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.count("*").alias("n"), held)
    grouped = materialise(grouped, "blocks")
    known = grouped.select("block", "pivot", "low", "high", "n").orderBy("block").toPandas()  # BLOCKS + PIVOTS rows at most
    return Blocks(grouped.select("block", "rows"), *(known[c].to_numpy() for c in ("block", "pivot", "low", "high", "n")))
