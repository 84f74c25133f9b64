"""Substring dedup: suffix automata over reference shards, matching statistics of the documents streamed past them.

A window of 20 words goes if it also stands earlier. To bring its copies together, each window names an anchor: of
the 13 runs of 8 words in it the one with the smallest hash, the same in every copy. An anchor's context, 12 words
to either side, holds all windows that name it, so the contexts of one anchor run are a reference shard: whatever
copies a window has, they meet there. Of equal contexts the earliest stands for all and the others go whole; where
different contexts are left, a suffix automaton takes them in document order, each first matched against it. Words
at which the match is 20 or longer and began elsewhere end a repeated window.

The automata of all shards together grow with the corpus, so a shard's automaton is made in the task its contexts are
dealt to rather than sent to every executor; it is bounded by LIMIT contexts. A shard with more of them (a line that
stands in a large part of all documents, each time between other words) is split into shards of one window each.
Equal contexts are collapsed before they are dealt, batch by batch, so a hot shard receives one row a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.common import as_bytes
from framewell.plans.joins import small
from framewell.session import materialise

SPAN, GRAM = 20, 8
SIDE = SPAN - GRAM
#: Contexts in an automaton at most, and contexts that are broadcast to their documents at most.
LIMIT = 1000
BROADCAST_ROWS = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SCHEMA = "key long, wide boolean, gram long, ctx long, doc long, pos int, before int, after int"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def anchors(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """(run hash, context hash, place, words before and after in the context) of the anchors that a text's windows name."""
    n = len(words)
    if n < SPAN:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    with np.errstate(over="ignore"):
        power = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _BASE)), dtype=np.uint64)
        back = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _BACK)), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n) * power, dtype=np.uint64))
        gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
        at = np.lib.stride_tricks.sliding_window_view(gram, SIDE + 1).argmin(axis=1) + np.arange(n - SPAN + 1)
        at = at[np.append(True, at[1:] != at[:-1])]
        before, after = np.minimum(at, SIDE), np.minimum(n - GRAM - at, SIDE) + GRAM
        low = at - before
        ctx = _mixed((sums[at + after] - sums[low]) * back[low] ^ (before * 64 + after).astype(np.uint64))
    return gram[at], ctx, at, before, after


class Automaton:
    """Suffix automaton of several sequences; each state knows where its words first ended."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, link: int, edges: dict, first) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.first.append(first)
        return len(self.length) - 1

    def _clone(self, p: int, word, q: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words: list, doc, start: int) -> None:
        last, nexts, links, lengths = 0, self.next, self.link, self.length
        for k, word in enumerate(words):
            q = nexts[last].get(word)
            if q is not None:  # these words stand in an earlier sequence as well
                last = q if lengths[q] == lengths[last] + 1 else self._clone(last, word, q)
                continue
            new, p = self._state(lengths[last] + 1, 0, {}, (doc, start + k + 1)), last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = new
                p = links[p]
            if p >= 0:
                q = nexts[p][word]
                links[new] = q if lengths[q] == lengths[p] + 1 else self._clone(p, word, q)
            last = new

    def matches(self, words: list, doc, start: int, span: int = SPAN) -> list[tuple[int, int]]:
        """Runs [start, end) of the sequence, which begins at `start` in doc, covered by spans that first ended elsewhere."""
        state = matched = 0
        nexts, links, lengths, out = self.next, self.link, self.length, []
        for k, word in enumerate(words):
            while state and word not in nexts[state]:
                state = links[state]
                matched = lengths[state]
            state = nexts[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= span:
                s = state
                while lengths[links[s]] >= span:
                    s = links[s]
                if self.first[s] != (doc, end := start + k + 1):
                    if out and out[-1][1] >= end - span:
                        out[-1] = (out[-1][0], end)
                    else:
                        out.append((end - span, end))
        return out


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c if isinstance(c, np.ndarray) else list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _contexts(batches):
    """Anchors of each document; of a batch's equal contexts the earliest. The others are runs to remove: gram and ctx null.

    key is what brings rows together: a run, or, where a batch holds a run in several contexts (wide), the run in its
    context, so that a run that stands in a large part of all documents is dealt by its contexts. Such a batch leaves one
    row without a context for the run, which tells its other rows that there are several.
    """
    for b in batches:
        docs, found = b.column(0).to_numpy(zero_copy_only=False), [anchors(t.split()) for t in as_bytes(b.column(1))]
        if not len(docs):
            continue
        gram, ctx, pos, before, after = (np.concatenate(c) for c in zip(*found, strict=True))
        doc = np.repeat(docs, [len(f[0]) for f in found])
        if not len(doc):
            continue
        order = np.lexsort((pos, doc, ctx, gram))
        gram, ctx, doc, pos, before, after = (x[order] for x in (gram, ctx, doc, pos, before, after))
        again = np.append(False, (gram[1:] == gram[:-1]) & (ctx[1:] == ctx[:-1]) & ((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))
        # equal rows of one document are the same place, told twice by repeated rows
        same = np.append(False, (gram[1:] == gram[:-1]) & (ctx[1:] == ctx[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1]))
        kept = ~again & ~same
        one, its = gram[kept], ctx[kept]
        first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        many = np.diff(np.append(first, len(one)))
        wide = np.repeat(many > 1, many)
        with np.errstate(over="ignore"):
            key = np.where(wide, _mixed(one ^ its * _BASE), one)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(wide), pa.array(one.view(np.int64)), pa.array(its.view(np.int64)), pa.array(doc[kept]), *(pa.array(x[kept].astype(np.int32)) for x in (pos, before, after))],
            names=_NAMES,
        )
        told = one[first[many > 1]]
        if len(told):
            grams, none = pa.array(told.view(np.int64)), [pa.nulls(len(told), k) for k in (pa.int64(), pa.int64(), *[pa.int32()] * 3)]
            yield pa.RecordBatch.from_arrays([grams, pa.array(np.zeros(len(told), bool)), grams, *none], names=_NAMES)
        # runs of one document, merged
        doc, start, end = doc[again], (pos - before)[again], (pos + after)[again]
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        if len(doc):
            cut = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1]))  # ends rise with starts in a document
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(doc)) - 1
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, pa.array(np.zeros(len(first), bool)), none, none, pa.array(doc[first]), pa.array(start[first].astype(np.int32)), pa.array(np.zeros(len(first), np.int32)), pa.array((end[last] - start[first]).astype(np.int32))],
                names=_NAMES,
            )


def _shards(batches):
    """(gram, doc, pos, start, words) of the contexts that documents are asked for; of a split shard, its windows."""
    names, kinds = ["gram", "doc", "pos", "start", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for b in batches:
        out, windows, runs = [], {}, []
        for doc, text, asked in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = text.split()
            for a in asked:
                start, end = a["pos"] - a["before"], a["pos"] + a["after"]
                if not a["split"]:
                    out.append((a["gram"], doc, a["pos"], start, b" ".join(words[start:end])))
                    continue
                for s in range(start, end - SPAN + 1):
                    if s <= a["pos"] <= s + SIDE:
                        window = b" ".join(words[s : s + SPAN])
                        known = windows.get(window)
                        if known is None or (doc, s) < known:
                            windows[window], known, s0 = (doc, s), (doc, s), known
                            if s0 is not None:
                                runs.append(s0)
                        elif known != (doc, s):
                            runs.append((doc, s))
        # a batch's own later copies of a window need no automaton: runs without words
        out += [(None, doc, s, s, None) for doc, s in set(runs)]
        out += [(xxhash.xxh64_intdigest(w) - (1 << 63), doc, s, s, w) for w, (doc, s) in windows.items()]
        yield _batch(out, names, kinds)


def _streamed(batches):
    """Rows (doc, start, end) to remove, from contexts that come shard by shard in document order."""
    names, kinds = ["doc", "start", "end"], [pa.int64(), pa.int64(), pa.int64()]
    shard, automaton = None, None
    for b in batches:
        out = []
        for gram, doc, _, start, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if gram is None:
                out.append((doc, start, start + SPAN))
                continue
            words = words.split(b" ")
            if gram != shard:
                shard, automaton = gram, Automaton()
            else:
                out += [(doc, s, e) for s, e in automaton.matches(words, doc, start)]
            automaton.add(words, doc, start)
        yield _batch(out, names, kinds)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(key, text), key in document order: the id where ids are whole and unique; otherwise rows are numbered by id
    (nulls first) and text, equal rows alike. True if the key is the id."""
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    ids = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1 or key is null")
    return (rows, True) if ids.isEmpty() else (rows, False)


def repeated_runs(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc, runs): for each key of rows (key, text) with something to remove, word ranges [start, end), which may overlap."""
    spark = rows.sparkSession
    found = rows.select("key", "text").mapInArrow(_contexts, _SCHEMA)
    # runs that are known already keep to themselves in the shuffle
    shard = Window.partitionBy(F.coalesce("key", F.xxhash64("doc", "pos")))
    marked = F.count(F.when(F.col("gram").isNotNull() & F.col("doc").isNull(), 1)).over(shard) > 0
    told = found.select(
        "*",
        (F.lag("ctx").over(shard.orderBy("gram", "ctx", "doc", "pos")) == F.col("ctx")).alias("again"),
        (F.col("wide") | marked | (F.min("ctx").over(shard) != F.max("ctx").over(shard))).alias("several"),
    ).filter("doc is not null and (gram is null or again or several)")
    told = materialise(told.select("gram", "doc", "pos", "before", "after", (F.col("gram").isNull() | F.coalesce("again", F.lit(False))).alias("gone")), "contexts")
    runs = told.filter("gone").select("doc", (F.col("pos") - F.col("before")).cast("long").alias("start"), (F.col("pos") + F.col("after")).cast("long").alias("end"))
    left = told.filter("not gone")
    large = left.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("gram", F.lit(True).alias("split"))
    large = small(materialise(large, "large"))
    asked = left.join(large, "gram", "left").groupBy("doc").agg(F.collect_list(F.struct("gram", "pos", "before", "after", F.coalesce("split", F.lit(False)).alias("split"))).alias("asked"))
    asked = materialise(asked, "asked")
    contexts = rows.join(F.broadcast(asked) if left.count() <= BROADCAST_ROWS else asked, F.col("key") == F.col("doc")).select("doc", "text", "asked").mapInArrow(_shards, "gram long, doc long, pos long, start long, words binary")
    dealt = contexts.repartition(F.coalesce("gram", F.xxhash64("doc", "start"))).sortWithinPartitions("gram", "doc", "pos")
    streamed = dealt.mapInArrow(_streamed, "doc long, start long, end long")
    return runs.unionByName(streamed).groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("runs"))


def kept_words(words: list[bytes], runs: list[dict] | None) -> list[bytes]:
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        gone[r["start"]] += 1
        gone[r["end"]] -= 1
    stay = np.cumsum(gone)[:-1] == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_removed, kept (its kept words joined by one blank).

    Null texts have no words. Rows that repeat an id and a text are one document and are treated alike; of rows that
    repeat an id alone the one whose text sorts first comes earlier; null ids come before others. An empty table
    gives an empty result. A text of fewer than 20 words is kept.
    """
    rows, whole = _keyed(docs, id_col, text_col)
    if not whole:
        order = rows.select(F.col("key").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).distinct()
        order = order.repartitionByRange(F.col("_id").asc_nulls_first(), "_text").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
        order = materialise(order.withColumn("_key", F.monotonically_increasing_id()), "order")
        rows = rows.join(order, rows["key"].eqNullSafe(order["_id"]) & (F.coalesce("text", F.lit("")) == order["_text"]))
        rows = rows.select(F.col("_key").alias("key"), "text", F.col("_id").alias("id"))
    else:
        # the same rows as repeated_runs joins, so that one shuffle of the texts serves both joins
        rows = rows.filter("key is not null")
    joined = rows.join(repeated_runs(rows.select("key", "text")), F.col("key") == F.col("doc"), "left")
    joined = joined.select(F.col("key" if whole else "id").alias("id"), "text", "runs")

    def run(batches):
        names, kinds = ["id", "n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            out = []
            for i, text, runs in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = text.split()
                kept = kept_words(words, runs)
                out.append((i, len(words), len(words) - len(kept), b" ".join(kept)))
            yield _batch(out, names, kinds)

    return joined.mapInArrow(run, "id long, n_words long, n_removed long, kept binary")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))



OP10_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, s + o AS p FROM r, (SELECT unnest(range(20)) AS o)),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
k AS (SELECT u.doc_id, count(g.p) AS gone, string_agg(u.x, ' ' ORDER BY u.p) FILTER (g.p IS NULL) AS kept FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.p = u.p GROUP BY u.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
