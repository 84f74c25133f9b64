"""Packing of documents into training sequences by deficit round-robin over the sources.

Every source is a queue of packets, runs of at most PACKET ids of one document. In each round a queue's deficit
grows by its quantum, its share of a window; it sends packets as long as the next one fits its deficit and carries
the rest. As long as a queue has packets, it has sent no more than round x quantum ids after any round, so the
round in which a packet leaves is ceil(ids of the queue up to its end / quantum): rounds, and with them the
deficits carried across windows and partitions, follow from running sums alone, and no task has to replay another.
The stream by (round, source, place in the queue) is then cut at every 4096 ids. What is left at its end is cut
into runs whose lengths are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.common import text_batches
from framewell.llm.tokens import word_ids
from framewell.session import materialise

WINDOW = 4096
#: Ids in a packet at most.
PACKET = 1024
END_OF_DOCUMENT = 2
#: Windows whose ids meet in one group of the running sum about.
GROUP_WINDOWS = 64
#: Rows of the table of queue offsets (tasks x sources) that are broadcast at most; a larger one is joined.
BROADCAST_ROWS = 1_000_000


def packets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None, packet: int = PACKET) -> DataFrame:
    """(task, source, doc, doc_id, start, length, doc_tokens, upto, ids), written once.

    A queue's order is by task, then as read; upto counts the queue's ids in its task up to the packet's end. doc
    tells documents apart that share an id. A null text is empty: it has the end id alone.
    """

    text_batches(docs.sparkSession)

    def run(batches):
        coder, task = word_ids(tokenizer), TaskContext.get().partitionId()
        sent: dict[str | None, int] = {}
        number = 0
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc_id, text, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = coder.encode(text or "") + END_OF_DOCUMENT.to_bytes(2, "little")
                n, number = len(ids) // 2, number + 1
                for start in range(0, n, packet):
                    length = min(packet, n - start)
                    sent[source] = sent.get(source, 0) + length
                    for column, x in zip(out, (task, source, task << 33 | number, doc_id, start, length, n, sent[source], ids[2 * start : 2 * (start + length)]), strict=True):
                        column.append(x)
                if len(out[0]) >= 4096:
                    yield _batch(out)
                    out = [[] for _ in range(9)]
            yield _batch(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    return materialise(rows.mapInArrow(run, "task long, source string, doc long, doc_id long, start long, length long, doc_tokens long, upto long, ids binary"), "packets")


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["task", "source", "doc", "doc_id", "start", "length", "doc_tokens", "upto", "ids"])


def streamed(rows: DataFrame, weights: dict[str | None, float] | None = None, window: int = WINDOW) -> tuple[DataFrame, int]:
    """(packets with `at`, their place in the stream, from 0; the stream's length).

    weights: target shares of the sources, the corpus's own where none are given; a source without a weight gets
    the smallest. A queue that runs out leaves the rounds to the others.
    """
    spark = rows.sparkSession
    parts = rows.groupBy("source", "task").agg(F.sum("length").alias("n"))
    parts = materialise(parts, "queues")
    totals = {r["source"]: int(r["n"]) for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row a source
    total = sum(totals.values())
    if not total:
        return rows.withColumn("at", F.lit(0).cast("long")), 0
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    share = dict(totals) if weights is None else {s: weights.get(s, min(weights.values())) for s in order}
    quantum = {s: max(1, round(window * share[s] / sum(share.values()))) for s in order}
    rounds = max(-(-totals[s] // quantum[s]) for s in order)
    known = spark.createDataFrame([(s, k, quantum[s]) for k, s in enumerate(order)], "_qs string, rank int, quantum long")
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    offsets = materialise(offsets.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_qs"))).select(F.col("source").alias("_qs"), F.col("task").alias("_qt"), "off", "rank", "quantum"), "offsets")
    small = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    queued = rows.join(small, rows["source"].eqNullSafe(F.col("_qs")) & (rows["task"] == F.col("_qt")))
    upto = F.col("upto") + F.col("off")
    queued = queued.select("rank", "doc", "doc_id", "start", "length", "doc_tokens", upto.alias("upto"), F.expr(f"(upto + off + quantum - 1) div quantum").alias("round"), "ids")
    queued = queued.withColumn("part", F.expr(f"round div {GROUP_WINDOWS}"))
    sums = queued.groupBy("part").agg(F.sum("length").alias("_n"))
    # groups of rounds in turn: sums over a thousand groups each, and over those
    sums = materialise(sums.withColumn("_thousand", F.expr("part div 1000")), "sums")
    wide = sums.groupBy("_thousand").agg(F.sum("_n").alias("_w"))
    every = Window.orderBy("_thousand").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.select("_thousand", F.coalesce(F.sum("_w").over(every), F.lit(0)).alias("_w"))
    inner = Window.partitionBy("_thousand").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_o", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(wide, "_thousand").select("part", (F.col("_o") + F.col("_w")).alias("_off"))
    if rounds // GROUP_WINDOWS <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    inside = Window.partitionBy("part").orderBy("round", "rank", "upto")
    placed = queued.withColumn("_run", F.sum("length").over(inside) - F.col("length")).join(sums, "part")
    return placed.withColumn("at", F.col("_run") + F.col("_off")).drop("_run", "_off"), total


def sequence_bounds(total: int, window: int = WINDOW) -> tuple[int, list[int]]:
    """(full windows, where the sequences after them begin, the stream's end last): powers of two, longest first."""
    full, at = divmod(total, window)
    at, rest, bounds = full * window, at, [full * window]
    for k in reversed(range(window.bit_length())):
        if rest >> k & 1:
            at += 1 << k
            bounds.append(at)
    return full, bounds


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None, weights: dict | None = None, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, unsigned 16 bits), doc_tokens, sequence_id, offset, ids_crc32,
    document (a number of its own for each row of docs, which tells pieces of rows with equal ids apart).

    Null ids and repeated rows are packed like others; a null source is a queue of its own, the last. Each id lies in
    one piece; an empty table gives no piece. window is a power of two; a sequence is shorter only at the end, and
    then a power of two long.
    """
    stream, total = streamed(packets(docs, id_col, text_col, source_col, tokenizer), weights, window)
    full, bounds = sequence_bounds(total, window)

    def run(batches):
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "ids_crc32", "document"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, start, length, n, at, ids, doc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                done = 0
                while done < length:
                    here = at + done
                    if here < bounds[0]:
                        seq, offset = divmod(here, window)
                        room = window - offset
                    else:
                        k = next(k for k in range(1, len(bounds)) if here < bounds[k])
                        seq, offset, room = full + k - 1, here - bounds[k - 1], bounds[k] - here
                    size = min(room, length - done)
                    piece = ids[2 * done : 2 * (done + size)]
                    crc = zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes())
                    for column, x in zip(out, (doc_id, start + done, size, piece, n, seq, offset, crc, doc), strict=True):
                        column.append(x)
                    done += size
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    rows = stream.select("doc_id", "start", "length", "doc_tokens", "at", "ids", "doc")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, ids_crc32 long, document long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "document")
