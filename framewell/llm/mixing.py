"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is one stream of words, its documents in an order that a hash permutes, cut into blocks of equal length
(at most 1 % of the source). A source's target gives an exact quota of blocks: all of them as often as the target
holds the source whole, and for the rest as many as it takes, the last one cut to the words still wanted. The tree's
root holds all quotas; each node splits its quotas between its halves by one draw without replacement (seeded by the
node), down to one leaf an output shard. A leaf's share of a source is a run of that source's permuted blocks, so the
shards' blocks are disjoint; what the documents have in a shard's blocks are its pieces, and each shard shuffles its
pieces by itself. Words, not documents, are counted: a block may begin and end inside a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.common import WORD, map_arrow, text_batches, text_or_empty
from framewell.session import materialise

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's size over that of all sources, and the most often that a source is taken.
SHARE, TIMES = 1.5, 2
#: Words of a block, unless 1 % of its source is less or MOST_BLOCKS is passed, and blocks of a mix about: numpy's
#: draws are exact for populations below 10 ** 9.
BLOCK_WORDS, MOST_BLOCKS = 2048, 8 * 10**8
#: Words that an output shard holds about, shards at least and at most, and numbers of the tree's leaves (a source, a
#: shard) that are broadcast at most: with more sources there are fewer shards.
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS, LEAF_NUMBERS = 1 << 18, 16, 1 << 16, 8 * 10**6
#: Documents that meet in one group of the running sums about.
GROUP_DOCS = 1 << 9


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, times: float = TIMES) -> list[float]:
    """Words to take of each source: by weight, none over `times` its size, the excess reshared by weight."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    free = [k for k, s in enumerate(sizes) if s > 0]
    while free:
        even = total / sum(weight[k] for k in free)
        over = [k for k in free if even * weight[k] > times * sizes[k]]
        if not over:
            for k in free:
                out[k] = even * weight[k]
            break
        for k in over:
            out[k] = float(times * sizes[k])
            total -= out[k]
            free.remove(k)
    return out


def permuted(index: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """A keyed permutation of range(n), element by element: Feistel rounds over the next power of four, walked into range."""
    n = np.broadcast_to(np.asarray(n, np.uint64), np.shape(index))
    half = np.array([max(1, (max(1, int(m) - 1).bit_length() + 1) // 2) for m in np.unique(n)], np.uint64)[np.searchsorted(np.unique(n), n)]
    low = (np.uint64(1) << half) - np.uint64(1)
    key = np.broadcast_to(np.asarray(key, np.uint64), np.shape(index))

    def rounds(x, half, low, key):
        left, right = x >> half, x & low
        for k in range(4):
            mixed = (right + key * np.uint64(2 * k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & low)
        return left << half | right

    with np.errstate(over="ignore"):
        out = rounds(np.asarray(index, np.uint64), half, low, key)
        while (far := out >= n).any():
            out[far] = rounds(out[far], half[far], low[far], key[far])
    return out.astype(np.int64)


def leaf_quotas(quotas: list[int], leaves: int, leaf: int, seed: int) -> tuple[list[int], list[int]]:
    """(blocks of each source before the leaf, blocks in the leaf): one path down the splitting tree.

    Leaves hold equal numbers of blocks, to within one; the draws of a node depend on the seed and the node alone.
    """
    total, held, before = sum(quotas), list(quotas), [0] * len(quotas)
    low, high = 0, leaves
    while high - low > 1:
        mid = (low + high) // 2
        left_size = total * mid // leaves - total * low // leaves
        rng, left, rest, todo = np.random.default_rng([seed, low, high]), [], sum(held), left_size
        for n in held:  # one source after the other, each draw given those before: together a multivariate draw
            k = int(rng.hypergeometric(n, rest - n, todo))
            left.append(k)
            rest, todo = rest - n, todo - k
        if leaf < mid:
            high, held = mid, left
        else:
            low, before, held = mid, [b + x for b, x in zip(before, left, strict=True)], [h - x for h, x in zip(held, left, strict=True)]
    return before, held


def _sizes(docs: DataFrame, source_col: str, text_col: str, id_col: str) -> list:
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    return [F.col(id_col).cast("long").alias("key"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("tie")]


def sized(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, key, source, size, tie), written once: row tells repeated rows apart, key is the id, size counts a text's
    words (null: 0), tie is the text's hash."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), *_sizes(docs, source_col, text_col, id_col)), "sized")


def source_targets(rows: DataFrame) -> list[dict]:
    """For each source by code point, null last: source, size, docs, target. One row a source comes to the driver."""
    found = [(r["source"], int(r["size"]), r["docs"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    return [{"source": s, "size": n, "docs": d, "target": t} for (s, n, d), t in zip(found, targets([n for _, n, _ in found]), strict=True)]


class Plan:
    """A mix's numbers by source: blocks and their length, how often the source is taken whole, words and blocks of the rest."""

    def __init__(self, plan: list[dict], seed: int, block: int | None = None, shards: int | None = None) -> None:
        size, target = (np.array([p[k] for p in plan], dtype) for k, dtype in (("size", np.int64), ("target", np.float64)))
        most = block or max(BLOCK_WORDS, int(-(-2 * size.sum() // MOST_BLOCKS)))
        self.seed, self.size = seed, size
        self.block = np.clip(size // 100, 1, most) if block is None else np.full(len(size), block)
        self.count = -(-size // self.block)
        self.whole = np.where(size > 0, target // np.maximum(size, 1), 0).astype(np.int64)
        self.rest = np.rint(target - self.whole * size).astype(np.int64)
        # the stream's last block is short; where it falls among the rest's blocks, the rest may need one more
        self.missing = self.count * self.block - size
        self.short = np.array([int(self.turn(np.array([c - 1]), np.array([k]), int(w))[0]) if c else 0 for k, (c, w) in enumerate(zip(self.count, self.whole, strict=True))], np.int64)
        self.part = -(-self.rest // self.block)
        self.part += self.before(self.part, np.arange(len(plan))) < self.rest
        self.quotas = (self.whole * self.count + self.part).tolist()
        words = int((self.whole * size + self.rest).sum())
        self.shards = shards or max(1, min(max(LEAST_SHARDS, -(-words // SHARD_WORDS)), MOST_SHARDS, LEAF_NUMBERS // max(1, len(plan))))

    def turn(self, index: np.ndarray, rank: np.ndarray, epoch: int) -> np.ndarray:
        """The place of blocks in their source's permutation of an epoch."""
        return permuted(index, self.count[rank], rank * 64 + epoch + 1 + self.seed)

    def before(self, turn: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Words of the rest's blocks that come before a place."""
        return turn * self.block[rank] - np.where(self.short[rank] < turn, self.missing[rank], 0)


def draws(rows: DataFrame, plan: Plan) -> DataFrame:
    """What the mix takes: (row, epoch, start, end, shard, place), words [start, end) of a document in an output shard.

    rows has row, key, source, size and tie; the permuted order depends on key, size and tie (on row only between rows
    that are the same in these), so reruns agree however the input is split. A shard is read by (place, epoch, start):
    place is random. Documents without words are not taken. Per epoch no word is taken twice.
    """
    spark, seed = rows.sparkSession, plan.seed
    if not sum(plan.quotas):
        return rows.select("row", *[F.lit(0).cast("long").alias(c) for c in ("epoch", "start", "end", "shard", "place")]).limit(0)

    # where each document begins in its source's permuted stream: sums within groups of a hash, and over the groups;
    # a source has groups by its documents, so those of a hot one are no larger than others
    known = spark.createDataFrame([(p["source"], k, -(-p["docs"] // GROUP_DOCS)) for k, p in enumerate(plan.sources)], "_s string, rank int, _groups long")  # one row a source
    order = F.xxhash64("key", "size", "tie", F.lit(seed))
    hashed = rows.filter("size > 0").join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_s")))
    hashed = hashed.select("row", "key", "tie", "rank", "size", order.alias("_h"), F.pmod(order, F.col("_groups")).alias("_g"))
    within = Window.partitionBy("rank", "_g").orderBy("_h", "key", "size", "tie", "row")
    before = Window.partitionBy("rank").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("rank", "_g").agg(F.sum("size").alias("_n")).select("rank", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = hashed.withColumn("_run", F.sum("size").over(within) - F.col("size")).join(sums, ["rank", "_g"])
    placed = placed.select("row", "rank", "size", (F.col("_run") + F.col("_off")).alias("at"))

    # shares of the leaves: each leaf walks its own path
    quotas, leaves = plan.quotas, plan.shards

    def walk(batch):
        for leaf in batch.column(0).to_pylist():
            first, held = leaf_quotas(quotas, leaves, leaf, seed)
            yield {"leaf": [leaf] * len(held), "rank": list(range(len(held))), "first": first, "held": held}

    paths = materialise(map_arrow(spark.range(leaves), walk, "leaf long, rank int, first long, held long"), "leaves")
    # a leaf's first blocks by source, LEAF_NUMBERS at most: each task needs them to place its blocks
    firsts = np.empty((len(quotas), leaves), np.int64)
    for r in paths.select("rank", "leaf", "first").toLocalIterator():
        firsts[r["rank"], r["leaf"]] = r["first"]
    table = spark.sparkContext.broadcast((plan, firsts))

    def take(batch):
        p, first_of = table.value
        row, rank, size, at = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
        block = p.block[rank]
        first, last = at // block, (at + size - 1) // block
        many = last - first + 1
        doc = np.repeat(np.arange(len(row)), many)
        index = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
        rank, block = rank[doc], block[doc]
        for epoch in range(int(p.whole.max(initial=0)) + 1):
            turn = p.turn(index, rank, epoch)
            # of the rest's last block only the words still wanted
            wanted = np.where(epoch < p.whole[rank], block, np.where(epoch == p.whole[rank], np.clip(p.rest[rank] - p.before(turn, rank), 0, block), 0))
            start = np.maximum(index * block, at[doc]) - at[doc]
            end = np.minimum(index * block + wanted, at[doc] + size[doc]) - at[doc]
            on = end > start
            draw, shard = turn + epoch * p.count[rank], np.zeros(len(doc), np.int64)
            for k in np.unique(rank):
                mine = rank == k
                shard[mine] = np.searchsorted(first_of[k], draw[mine], side="right") - 1
            with np.errstate(over="ignore"):
                place = ((at[doc] + start) * 64 + rank + epoch * 31).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed)
                place = ((place ^ (place >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
            yield {"row": row[doc][on], "epoch": np.full(on.sum(), epoch), "start": start[on], "end": end[on], "shard": shard[on], "place": place[on]}

    return map_arrow(placed, take, "row long, epoch long, start long, end long, shard long, place long")


def planned(rows: DataFrame, seed: int = 7, block: int | None = None, shards: int | None = None) -> Plan:
    """The plan of a mix of sized rows. block: words of a block (by default by source); shards: their number (by default by size)."""
    sources = source_targets(rows)
    plan = Plan(sources, seed, block, shards)
    plan.sources = sources
    return plan


def mixed(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 7, block: int | None = None, shards: int | None = None) -> tuple[DataFrame, DataFrame, Plan]:
    """(sized rows, draws, plan). Null sources are one source, the last; empty texts have size 0 and are not taken."""
    rows = sized(docs, source_col, text_col, id_col)
    plan = planned(rows, seed, block, shards)
    return rows, draws(rows, plan), plan


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """layout lists a document's pieces as epoch:start:end:shard:turn, turn being the piece's place in its shuffled shard."""
    rows, drawn, plan = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    turn = F.row_number().over(Window.partitionBy("shard").orderBy("place", "epoch", "start", "row")) - 1
    pieces = drawn.select("row", F.col("end") - F.col("start"), F.struct("epoch", "start", "end", "shard", turn.alias("turn")).alias("piece")).toDF("row", "words", "piece")
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    known = spark.createDataFrame([(p["source"], p["size"], p["target"]) for p in plan.sources], "_s string, source_size long, target double")
    joined = rows.join(taken, "row", "left").join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_s")))
    layout = F.array_join(F.transform("pieces", lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("epoch", "start", "end", "shard", "turn")])), ",")
    return joined.select(F.col("key").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(layout, F.lit("")).alias("layout"))


def mixed_documents(docs: DataFrame, seed: int = 7, block: int | None = None, shards: int | None = None) -> DataFrame:
    """The documents that the mix takes, as rows of docs, shard by shard and shuffled inside each: what a shard takes of a
    document in one epoch is one row, its text those words.

    doc_id repeats for each epoch and shard that take part of the document; n_chars follows the text. A block boundary
    cuts between words, and the words are joined as they stand in the text (from the first word's start to the last's
    end). The rows are numbered and written once, so other columns may have any names and types.
    """
    text_batches(docs.sparkSession)
    names = docs.columns
    inner = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("row"), *_sizes(docs, "source", "text", "doc_id"), *inner), "numbered")
    plan = planned(numbered, seed, block, shards)
    drawn = draws(numbered.select("row", "key", "source", "size", "tie"), plan)
    each = drawn.groupBy("row", "epoch", "shard").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"), F.min("place").alias("place"))
    text, others = f"c{names.index('text')}", [f"c{k}" for k, c in enumerate(names) if c not in ("text", "n_chars")]

    def cut(batch):
        import re

        word, out = re.compile(WORD), []
        for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = [m.span() for m in word.finditer(text)]
            merged: list[list[int]] = []
            for r in runs:
                if merged and merged[-1][1] == r["start"]:
                    merged[-1][1] = r["end"]
                else:
                    merged.append([r["start"], r["end"]])
            out.append("\n".join(text[at[a][0] : at[b - 1][1]] for a, b in merged))
        return out

    def run(batches):
        for b in batches:
            text = cut(b)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*b.schema.names[2:], "text", "n_chars"])

    schema = ", ".join(["shard long", "place long", *[f"{c} {numbered.schema[c].dataType.simpleString()}" for c in others], "text string", "n_chars long"])
    rows = numbered.select("row", text, *others).join(each, "row").select(text, "runs", "shard", "place", *others).mapInArrow(run, schema)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "place")
    told = {"text": "text", "n_chars": "n_chars"}
    return rows.select(*[F.col(told.get(c, f"c{k}")).alias(c) for k, c in enumerate(names)])
