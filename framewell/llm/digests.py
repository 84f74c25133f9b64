"""Document fingerprints: an exact digest of the canonical text, with bytes compared inside equal buckets.

The canonical text is NFKC-normalised, case-folded, normalised again, with white space folded to single blanks.
Its 128-bit XXH3 is the bucket; inside a bucket of several rows the canonical texts are compared byte by byte, and
texts that differ get fingerprints of their own.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.session import materialise

#: Rows of ids that are broadcast at most when buckets are compared; beyond that they are joined.
BROADCAST_ROWS = 1_000_000


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    once = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", once).split()).encode()


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def bucket_clashes(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of=digest) -> DataFrame:
    """(fingerprint, canonical, place) of the buckets of prints (id, fingerprint) whose canonical texts are not all the same bytes.

    Rows alone in their bucket need no comparison. A bucket's smallest and largest text say whether it holds
    several; both are combined before the shuffle, so a bucket with a third of all rows sends two texts a task.
    """
    many = materialise(prints.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"), "many")
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    ids = materialise(prints.join(many, "fingerprint", "left_semi").select(F.col("id").alias("_cmp_id")), "buckets")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(ids, rows["id"].eqNullSafe(F.col("_cmp_id")), "left_semi").select("text")

    def run(batches):
        for b in batches:
            texts = [canonical(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(t) for t in texts], pa.string()), pa.array(texts, pa.binary())], names=["fingerprint", "canonical"])

    texts = rows.mapInArrow(run, "fingerprint string, canonical binary")
    mixed = materialise(texts.groupBy("fingerprint").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high")).filter("low <> high").select("fingerprint"), "clashes")
    if mixed.isEmpty():
        return mixed.select("fingerprint", F.lit(None).cast("binary").alias("canonical"), F.lit(0).alias("place"))
    each = texts.join(mixed, "fingerprint", "left_semi").distinct()
    return each.withColumn("place", F.row_number().over(Window.partitionBy("fingerprint").orderBy("canonical")) - 1)


def separating(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of=digest):
    """digest_of where it keeps all canonical texts of docs apart, told by their bytes (prints: id, fingerprint by digest_of);
    otherwise a digest with a second one after it in the buckets that hold several texts, compared by bytes as well."""
    clashes = bucket_clashes(docs, prints, id_col, text_col, digest_of).select("fingerprint").distinct()
    if clashes.isEmpty():
        return digest_of
    few = [r["fingerprint"] for r in clashes.limit(BROADCAST_ROWS + 1).collect()]
    # with so many clashes every text gets the second digest
    bad = frozenset(few) if len(few) <= BROADCAST_ROWS else None

    def longer(data: bytes) -> str:
        told = digest_of(data)
        return f"{told}+{hashlib.sha256(data).hexdigest()}" if bad is None or told in bad else told

    return longer


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of=digest) -> DataFrame:
    """(id, fingerprint) of every whole text; null is empty. Equal canonical texts, and only those, have equal fingerprints."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def told(by):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([by(canonical(t or "")) for t in b.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

        return materialise(rows.mapInArrow(run, "id long, fingerprint string"), "digests")

    prints = told(digest_of)
    exact = separating(docs, prints, id_col, text_col, digest_of)
    return prints if exact is digest_of else told(exact)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, task long, kind string, text string"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _compared(doc_id, text: str, after: str, mine: bytes, its: bytes, digest_of) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = canonical(edited)
    a, b = digest_of(mine), digest_of(changed)
    # equal digests are one bucket; there the bytes decide
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, float(a == b and mine == changed), float(a == digest_of(its) and mine == its)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of=digest) -> DataFrame:
    """One row a document, compared with its edited text and with the next document by ascending id (the first after the last).

    Null ids come first; rows that repeat an id follow each other by text, nulls first. A null text is empty; a
    document alone is its own next. The texts are dealt once, by ranges of the id; each range leaves open its last
    row and hands on its first, two texts a range, and these are joined to each other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        task, last, out = TaskContext.get().partitionId(), None, []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                mine = canonical(text)
                if last is None:
                    out.append((doc_id, *[None] * 6, task, "head", text))
                else:
                    out.append((*_compared(*last[:2], text, last[2], mine, digest_of), task, "done", None))
                last = (doc_id, text, mine)
            yield _batch(out)
            out = []
        if last is not None:
            yield _batch([(last[0], *[None] * 6, task, "tail", last[1])])

    seen = materialise(dealt.mapInArrow(run, _SCHEMA), "compared")
    ends = seen.filter("kind <> 'done'")
    # the ranges that hold rows, in order; only their numbers meet in one task
    tasks = ends.filter("kind = 'head'").select("task")
    turn = Window.orderBy("task")
    every = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = tasks.select("task", F.coalesce(F.lead("task").over(turn), F.first("task").over(every)).alias("next"))
    tails = ends.filter("kind = 'tail'").select("doc_id", "text", "task").join(follows, "task")
    heads = ends.filter("kind = 'head'").select(F.col("text").alias("after"), F.col("task").alias("next"))

    def close(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
            yield _batch([(*_compared(i, t, n, canonical(t), canonical(n), digest_of), 0, "done", None) for i, t, n in rows])

    closed = tails.join(heads, "next").select("doc_id", "text", "after").mapInArrow(close, _SCHEMA)
    return seen.filter("kind = 'done'").unionByName(closed).select(*_NAMES[:7])


def exact_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of=digest) -> DataFrame:
    """`with_next` by a digest that keeps all texts of docs apart."""
    told = materialise(with_next(docs, id_col, text_col, digest_of), "fingerprints")
    exact = separating(docs, told.select(F.col("doc_id").alias("id"), "fingerprint"), id_col, text_col, digest_of)
    return told if exact is digest_of else with_next(docs, id_col, text_col, exact)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return exact_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
