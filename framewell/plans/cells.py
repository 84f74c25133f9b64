"""Pairs of 64-bit hashes that agree in some of their bands, met in cells of bounded size; none is told twice.

A row goes to a bucket for each combination of `least` bands, by its bits in them. A bucket with more than CELL rows is
cut into parts that meet two by two, each two in a cell of their own. Two rows may meet in several buckets: the pair is
told where the combination is the first bands in which they agree, so pairs need no `distinct`, and none of them is
shuffled or held. What is written grows with the rows and the parts, not with the pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.functions.hashes import band_layout
from framewell.plans.joins import small
from framewell.session import materialise

#: Rows of a cell at most, or so; pairs looked at in one step; pairs in a batch that leaves a task.
CELL, STEP, BATCH = 1 << 16, 1 << 17, 1 << 16


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def dealt_to_cells(rows: DataFrame, bands: int, least: int) -> DataFrame:
    """(cell, combination, side, phash, id), sorted by the first three, from rows (id, phash).

    Rows of side 2 meet each other in their cell, those of side 0 the ones of side 1. Cells are numbers by hash: should
    two be one, rows meet in vain.
    """
    spark = rows.sparkSession
    masks = [_signed(sum(mask << shift for shift, mask in some)) for some in combinations(band_layout(bands), least)]
    keys = F.array(*[F.col("phash").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    keyed = rows.filter("phash is not null").select("id", "phash", F.posexplode(keys).alias("combination", "key"))
    if rows.limit(CELL + 1).count() > CELL:
        full = keyed.groupBy("combination", "key").agg(F.count("*").alias("n")).filter(F.col("n") > CELL)
        keyed = keyed.join(small(materialise(full, "full")), ["combination", "key"], "left")
        parts = F.coalesce(F.ceil(F.col("n") / (CELL // 2)).cast("int"), F.lit(1))
        keyed = keyed.withColumn("own", F.pmod(F.xxhash64("id", "phash"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        keyed = keyed.withColumns({"own": F.lit(0), "other": F.lit(0)})
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cell = F.xxhash64("combination", "key", F.least("own", "other"), F.greatest("own", "other"))
    told = keyed.select(cell.alias("cell"), "combination", side.alias("side"), "phash", "id")
    # as many tasks as asked for: their work is in the pairs, so they are not merged by the bytes of their rows
    return told.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "combination", "side")


def _cells(batches):
    """(combination, side, phash, id) of each cell, from sorted rows."""
    held, parts = None, []
    for b in batches:
        cell, combination, side, phash, ids = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(cell):
            continue
        cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(combination) != 0)) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(cell))
        more = ends - starts > 1  # a row alone in its cell meets none; the first and the last may go on in other batches
        more[0] = more[-1] = True
        for a, z in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            if (cell[a], combination[a]) != held:
                if parts:
                    yield held[1], *(np.concatenate(c) for c in zip(*parts, strict=True))
                held, parts = (cell[a], combination[a]), []
            parts.append((side[a:z], phash[a:z].view(np.uint64), ids[a:z]))
    if parts:
        yield held[1], *(np.concatenate(c) for c in zip(*parts, strict=True))


def _close(side: np.ndarray, phash: np.ndarray, radius: int):
    """Blocks of (i, j, differing bits): places of pairs in a cell that lie within the radius, each pair once."""
    whole = side[0] == 2
    split = len(side) if whole else int(np.searchsorted(side, 1))
    right = phash if whole else phash[split:]
    at, n = 0, len(right)
    while at < split and n > (at if whole else 0):
        from_ = at if whole else 0  # a row meets those after it
        wide = n - from_
        z = min(split, at + max(1, STEP // wide))
        xor = phash[at:z, None] ^ right[None, from_:]
        hit = np.arange(xor.size) if radius >= 64 else np.flatnonzero(np.bitwise_count(xor).ravel() <= radius)
        i, j = np.divmod(hit, wide)
        if whole:
            after = j > i
            hit, i, j = hit[after], i[after], j[after]
        if len(hit):
            yield i + at, j + (from_ if whole else split), xor.ravel()[hit]
        at = z


def pairs_in_cells(rows: DataFrame, radius: int, bands: int, least: int, value: str) -> DataFrame:
    """(a, b, value): pairs a < b of ids of rows (id, phash) that agree in `least` bands or more and lie within the radius.

    value: `distance`, the number of differing bits, an int, or `shared`, that of equal bands, a long.
    """
    layout = [np.uint64(mask << shift) for shift, mask in band_layout(bands)]
    some = [*combinations(range(bands), least)]
    own = np.array([sum(1 << b for b in c) for c in some], np.uint64)
    upto = np.array([(2 << c[-1]) - 1 for c in some], np.uint64)  # all bands to the combination's last

    def run(batches):
        kind = pa.int32() if value == "distance" else pa.int64()
        out, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), kind), strict=True)], names=["a", "b", value])

        for combination, side, phash, ids in _cells(batches):
            for i, j, xor in _close(side, phash, radius):
                agree = np.zeros(len(xor), np.uint64)
                for b, mask in enumerate(layout):
                    agree |= ((xor & mask) == 0).astype(np.uint64) << np.uint64(b)
                first = ((agree & own[combination]) == own[combination]) & (np.bitwise_count(agree & upto[combination]) == least)
                first &= ids[i] != ids[j]
                if not first.any():
                    continue
                x, y = ids[i[first]], ids[j[first]]
                out.append((np.minimum(x, y), np.maximum(x, y), np.bitwise_count(xor[first] if value == "distance" else agree[first])))
                held += len(x)
                if held >= BATCH:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    kind = "int" if value == "distance" else "long"
    return dealt_to_cells(rows, bands, least).mapInArrow(run, f"a long, b long, {value} {kind}")


def joined_in_cells(hashes: DataFrame, radius: int, bands: int, least: int) -> DataFrame:
    """(src, dst): of distinct hashes (phash), links within the radius that join in each cell what all its links join.

    No more than a link a hash leaves a cell, however many pairs lie within the radius.
    """

    def forest(side: np.ndarray, phash: np.ndarray) -> np.ndarray:
        root = np.arange(len(phash))
        for i, j, _ in _close(side, phash, radius):
            while True:
                x, y = root[i], root[j]
                apart = x != y
                if not apart.any():
                    break
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
        return root

    def run(batches):
        out, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out, strict=True)], names=["src", "dst"])

        for _, side, phash, _ in _cells(batches):
            root = forest(side, phash)
            moved = np.flatnonzero(root != np.arange(len(root)))
            out.append((phash[moved], phash[root[moved]]))
            held += len(moved)
            if held >= BATCH:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    return dealt_to_cells(hashes.select(F.col("phash").alias("id"), "phash"), bands, least).mapInArrow(run, "src long, dst long")
