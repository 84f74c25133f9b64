"""Packing of documents into as few sequences as minimum bin slack finds.

A bin takes the longest piece left and the set of other pieces that fills it best. Pieces are alike if they are equally
long, so what is left is a histogram of at most `window` numbers, whatever the corpus holds. The best set is a subset-sum
problem over that histogram, solved with one integer as a bit set of the sums that can be reached. A set that fills a bin
best does so again as long as there are enough pieces of its lengths: nothing that was not there before comes up. So each
solution is a pattern for as many bins as the histogram allows, and uses one of its lengths up; the number of patterns
follows from the number of lengths, not of documents, and the plan is small enough for the driver and for every task.
Pieces find their places by their turn among those of their length: their turn in their task, which the task counts
while it reads the texts, and the number of such pieces in the tasks before, a running sum over tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.common import map_arrow, text_batches
from framewell.llm.tokens import word_ids
from framewell.plans.joins import small
from framewell.session import materialise

WINDOW = 4096
END_OF_DOCUMENT = 1


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """(task, doc_id, document, piece, start, length, turn, ids, ids_crc32), written once.

    A document's ids end with END_OF_DOCUMENT; more than `window` are cut into pieces of `window`, the last one may be
    shorter. document tells rows apart that share an id; turn counts, from 0, a task's pieces of one length. A null text
    is empty and has the end id alone.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        coder, task, number = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        turns = np.zeros(window + 1, np.int64)
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = coder.encode(text or "") + END_OF_DOCUMENT.to_bytes(2, "little")
                number += 1
                for piece, start in enumerate(range(0, len(ids) // 2, window)):
                    part = ids[2 * start : 2 * (start + window)]
                    n = len(part) // 2
                    crc = zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes())
                    for column, x in zip(out, (task, doc_id, task << 33 | number, piece, start, n, int(turns[n]), part, crc), strict=True):
                        column.append(x)
                    turns[n] += 1
                if len(out[0]) >= 1024:
                    yield _batch(out)
                    out = [[] for _ in range(9)]
            yield _batch(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, "task long, doc_id long, document long, piece int, start long, length long, turn long, ids binary, ids_crc32 long"), "pieces")


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["task", "doc_id", "document", "piece", "start", "length", "turn", "ids", "ids_crc32"])


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill the room best: subset sums as bits of one integer, longest lengths first.

    counts: lengths in falling order. Among the fullest sets it is one of those that need the fewest of the short
    lengths: the walk back leaves a length out wherever the sum was reached without it.
    """
    mask, reached, steps = (1 << room + 1) - 1, 1, []
    for length, count in counts.items():
        if length > room:
            continue
        left, size = min(count, room // length), 1
        while left:  # counts as sums of powers of two
            take = min(size, left)
            steps.append((length, take, reached))
            reached |= reached << length * take & mask
            left, size = left - take, size * 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


@dataclass(frozen=True)
class Plan:
    """Runs of the pieces of each length, in their turn: where a run begins, pieces a bin, first bin, place in the bin."""

    bins: int
    runs: dict[int, np.ndarray]

    def place(self, length: int, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of pieces of one length, by their turns."""
        runs = self.runs[length]
        run = runs[np.searchsorted(runs[:, 0], turns, "right") - 1]
        at = turns - run[:, 0]
        return run[:, 2] + at // run[:, 1], run[:, 3] + at % run[:, 1] * length


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """Minimum bin slack over pieces of these lengths: every bin holds the longest piece left and what fills it best."""
    counts = {n: histogram[n] for n in sorted(histogram, reverse=True) if histogram[n]}
    used, runs, bins = dict.fromkeys(counts, 0), {n: [] for n in counts}, 0
    while counts:
        longest = next(iter(counts))
        rest = {n: c - (n == longest) for n, c in counts.items()}
        pattern = fullest({n: c for n, c in rest.items() if c}, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(counts[n] // c for n, c in pattern.items()), 0
        for n in sorted(pattern, reverse=True):
            c = pattern[n]
            runs[n].append((used[n], c, bins, offset))
            used[n] += c * times
            counts[n] -= c * times
            offset += n * c
            if not counts[n]:
                del counts[n]
        bins += times
    return Plan(bins, {n: np.array(r, np.int64) for n, r in runs.items()})


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, document, piece, start, length, ids (binary, unsigned 16 bits), ids_crc32, sequence_id, offset.

    Null ids and repeated rows are packed like others (`document` is a number of its own for each row of docs); an empty
    table gives no piece; other columns are not looked at. Sequences are numbered from 0 without gaps.
    """
    rows = pieces(docs, id_col, text_col, tokenizer, window)
    spark = rows.sparkSession
    sizes = materialise(rows.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `window` rows at most
    shared = spark.sparkContext.broadcast(plan(histogram, window))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sizes.select(F.col("task").alias("_t"), F.col("length").alias("_l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off")), "offsets")
    turned = rows.join(small(offsets), (F.col("task") == F.col("_t")) & (F.col("length") == F.col("_l")))
    turned = turned.select("doc_id", "document", "piece", "start", "length", "ids", "ids_crc32", (F.col("turn") + F.col("_off")).alias("turn"))

    def run(batch):
        length, turn = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "turn"))
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(some):
                bins[some], offsets[some] = shared.value.place(int(length[some[0]]), turn[some])
        yield {**{n: batch.column(k) for k, n in enumerate(batch.schema.names) if n != "turn"}, "sequence_id": pa.array(bins), "offset": pa.array(offsets)}

    return map_arrow(turned, run, "doc_id long, document long, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long")


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "document")
