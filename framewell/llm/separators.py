"""Token counts by a separator scan over flat, unindexed token files.

A flat file is one stream of ids without an index; documents end where the end-of-document id stands. It is read
block by block, each block by itself: one vectorised search gives the separators, and with them every document
that begins and ends inside. What crosses blocks is stitched by two prefix scans over a few numbers a block: the
sum of separators before it (which document comes first) and the largest separator place before it (where it began).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.tokens import word_ids
from framewell.session import materialise

#: Ids in a block, and the id that ends a document in the files that flat_files writes.
BLOCK = 1 << 16
END = 49407


def flat_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, block: int = BLOCK, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(blocks: file, block, ids binary; order: file, ordinal, doc_id), written once.

    One file a task of the scan; blocks are cut at equal lengths wherever documents end. A null text has its end
    alone. The strings of special tokens are ordinary text, so a text never holds the end id.
    """

    def run(batches):
        coder, task, stop = word_ids(tokenizer, plain_specials=True), TaskContext.get().partitionId(), end.to_bytes(2, "little")
        held, number, ordinal = bytearray(), 0, 0
        names, kinds = ["file", "block", "ids", "ordinal", "doc_id"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[task] * len(ids), [None] * len(ids), [None] * len(ids), range(ordinal, ordinal + len(ids)), ids], kinds, strict=True)], names=names)
            ordinal += len(ids)
            for text in b.column(1).to_pylist():
                held += coder.encode(text or "") + stop
                while len(held) >= 2 * block:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((task, number, bytes(held[: 2 * block]), None, None), kinds, strict=True)], names=names)
                    del held[: 2 * block]
                    number += 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((task, number, bytes(held), None, None), kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = materialise(rows.mapInArrow(run, "file long, block long, ids binary, ordinal long, doc_id long"), "flat")
    return both.filter("block is not null").select("file", "block", "ids"), both.filter("block is null").select("file", "ordinal", "doc_id")


def scan(blocks: DataFrame, end: int = END, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens): the documents of flat files, from 0 in each; n_tokens leaves out the end id.

    Every block of a file but the last has `block` ids. Ids after a file's last separator are a document without an
    end, and counted as its last; a file of separators alone has empty documents. A null block is empty.
    """

    def search(batches):
        # The rows of a block: ends of its documents, as places in the block; lengths follow from differences.
        for b in batches:
            for file, number, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(data or b"", dtype)
                ends = np.flatnonzero(ids == end)
                starts = np.append(-1, ends + 1)[: len(ends)]  # -1: it began in an earlier block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends[-1] if len(ends) else None], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (starts, ends))],
                    names=["file", "block", "n", "n_ends", "last", "starts", "ends"],
                )

    found = materialise(blocks.select("file", "block", "ids").mapInArrow(search, "file long, block long, n long, n_ends long, last long, starts array<long>, ends array<long>"), "ends")
    base = F.col("block") * block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file", base.alias("base"), F.arrays_zip("starts", "ends").alias("docs"),
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max(base + F.col("last")).over(before) + 1, F.lit(0)).alias("began"),
    )
    each = carried.select("file", "base", "first", "began", F.posexplode("docs").alias("k", "doc"))
    start = F.when(F.col("doc.starts") < 0, F.col("began")).otherwise(F.col("base") + F.col("doc.starts"))
    whole = each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("doc.ends") - start).alias("n_tokens"))
    files = found.groupBy("file").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max(base + F.col("last")) + 1, F.lit(0)).alias("start"))
    return whole.unionByName(files.filter("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens")))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens (without the end id), file, ordinal, start of every document, counted from the flat files alone."""
    blocks, order = flat_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scan(blocks).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
