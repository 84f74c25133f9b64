"""Ranked lexical search of a set of items over all documents, by an FP-tree of the documents.

Documents are read once, whole, and leave the vector of those of their terms that some item holds (a restricted vector),
their number of terms and no text. Each task then makes FP-trees of its documents, SHARD at a time: a vector is a path of
terms, the most frequent first, so documents share the beginnings of their paths; paths without branches are one edge.
A node knows the largest tf of each term below it and the smallest m, and so a score that no document below it passes.
For each item the tree is walked depth first, the best child first; a node is left out if that bound falls short of the
item's k-th best score so far, which is carried from tree to tree. Documents that are alike in all that counts are one leaf.

A task sends k documents an item at most, so what is shuffled is bounded by items x tasks. Items are taken in blocks of
at most ITEM_TERMS distinct terms or so each, so what is broadcast is bounded, however many items there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.common import as_bytes, text_batches
from framewell.session import materialise

TOP = 20
#: Documents of a tree at most.
SHARD = 4096
#: Documents below a node that make it a node of its own; fewer are leaves of the node above.
BRANCH = 8
#: Terms of all items of a block about.
ITEM_TERMS = 2_000_000
# ASCII letters and digits in lower case; other ASCII parts terms, and every byte of other characters stays.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def term_vectors(rows: DataFrame, keep: list[str], text_col: str, vocabulary=None) -> DataFrame:
    """(keep..., n, terms, tfs): a text's number of terms, repeats included, and its distinct terms with their counts.

    vocabulary: a broadcast dict from terms to numbers; then terms are the numbers of those that it holds. A null text
    has no terms.
    """
    text_batches(rows.sparkSession)
    numbered = vocabulary is not None
    kind = pa.int32() if numbered else pa.binary()
    some = rows.select(*keep, F.col(text_col).alias("_text"))

    def run(batches):
        known = vocabulary.value if numbered else None
        for b in batches:
            n, terms, tfs = [], [], []
            for text in as_bytes(b.column(b.num_columns - 1)):
                found = terms_of(text)
                count: dict = {}
                if numbered:
                    for t in map(known.get, found):
                        if t is not None:
                            count[t] = count.get(t, 0) + 1
                else:
                    for t in found:
                        count[t] = count.get(t, 0) + 1
                n.append(len(found))
                terms.append(list(count))
                tfs.append(list(count.values()))
            columns = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(terms, pa.list_(kind)), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "n", "terms", "tfs"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields[:-1])
    return some.mapInArrow(run, f"{fields}, n long, terms array<{'int' if numbered else 'binary'}>, tfs array<long>")


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """An FP-tree over documents (ids, m, and a row of terms and tfs each), laid out in arrays.

    Node 0 is the root. The children of a node stand side by side, and so do the documents that hang at it; each has its
    run in `terms` and `gains`, the gain of a term being what its weight is multiplied by, or at most so.
    """

    def __init__(self, docs: list[tuple[bytes, bytes, int, int | None]], top: int) -> None:
        """docs: (terms in order of frequency, big-endian 32 bits each; their tfs, 64 bits each; m; doc_id)."""
        docs.sort(key=lambda d: (d[0], d[1], d[2], d[3] is None, d[3] or 0))
        self.ids: list[list[int | None]] = []  # of each class of documents that score alike, the `top` smallest
        leaves, held = [], None
        for path, tf, m, doc_id in docs:
            if (path, tf, m) != held:
                held = (path, tf, m)
                leaves.append((np.frombuffer(path, ">u4").astype(np.int64), np.frombuffer(tf, "<i8"), m))
                self.ids.append([])
            if len(self.ids[-1]) < top:
                self.ids[-1].append(doc_id)
        shared = np.zeros(len(leaves) + 1, np.int64)  # terms that a path begins with as the one before it
        for k in range(1, len(leaves)):
            a, b = leaves[k - 1][0], leaves[k][0]
            n = min(len(a), len(b))
            unlike = np.flatnonzero(a[:n] != b[:n])
            shared[k] = unlike[0] if len(unlike) else n
        self._lay_out(leaves, self._branches(shared, len(leaves)))

    @staticmethod
    def _branches(shared: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        """(depth, first, end) of the inner nodes: runs of paths with one beginning, in postorder, the root last."""
        out, stack = [], [(0, 0)]
        for k in range(1, n + 1):
            depth, first = int(shared[k]) if k < n else -1, k - 1
            while stack and stack[-1][0] > depth:
                at, first = stack.pop()
                if k - first >= BRANCH or at == 0:
                    out.append((at, first, k))
            if depth >= 0 and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))
        return out or [(0, 0, n)]

    def _lay_out(self, leaves: list, nodes: list[tuple[int, int, int]]) -> None:
        kids: list[list[int]] = [[] for _ in nodes]
        docs: list[list[int]] = [[] for _ in nodes]
        below: list[tuple] = []
        open_: list[int] = []
        for k, (_, first, end) in enumerate(nodes):
            while open_ and nodes[open_[-1]][1] >= first:
                kids[k].append(open_.pop())
            kids[k].reverse()
            at = first
            for child in [*kids[k], None]:
                stop = end if child is None else nodes[child][1]
                docs[k] += range(at, stop)
                at = end if child is None else nodes[child][2]
            parts = [leaves[d] for d in docs[k]] + [below[c] for c in kids[k]]
            terms = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
            tfs = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
            order = np.argsort(terms, kind="stable")
            terms, tfs = terms[order], tfs[order]
            cut = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.empty(0, np.int64)
            below.append((terms[cut], np.maximum.reduceat(tfs, cut) if len(cut) else tfs, min(p[2] for p in parts)))
            open_.append(k)
        # children side by side, documents side by side
        self.child_run, self.doc_run, queue = [], [], [len(nodes) - 1]
        order, doc_order = [len(nodes) - 1], []
        for node in queue:
            self.child_run.append((len(order), len(order) + len(kids[node])))
            self.doc_run.append((len(doc_order), len(doc_order) + len(docs[node])))
            order += kids[node]
            queue += kids[node]
            doc_order += docs[node]
        self.nodes, self.docs = self._runs([below[k] for k in order]), self._runs([leaves[k] for k in doc_order])
        self.ids = [self.ids[k] for k in doc_order]

    @staticmethod
    def _runs(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each part begins, terms, gains); a part without terms gets one that no item holds."""
        none = (np.array([-1]), np.array([0]))
        parts = [(*(p[:2] if len(p[0]) else none), p[2]) for p in parts]
        sizes = [len(p[0]) for p in parts]
        starts = np.cumsum([0, *sizes])
        m = np.repeat(np.array([p[2] for p in parts], np.int64), sizes)
        return starts, np.concatenate([p[0] for p in parts]), gain(np.concatenate([p[1] for p in parts]), m)

    @staticmethod
    def _scores(runs: tuple, a: int, z: int, weights: np.ndarray) -> np.ndarray:
        starts, terms, gains = runs
        i, j = starts[a], starts[z]
        return np.add.reduceat(weights[terms[i:j]] * gains[i:j], starts[a:z] - i)

    def search(self, weights: np.ndarray, best: list[tuple[int, int]], top: int) -> tuple[list[tuple], int]:
        """(best `top` of `best` and of this tree's documents, nodes looked into). Entries are (-score, id is null, id).

        weights: a term's weight times its number in the item, 0 for others and for the last place.
        """
        looked, stack = 0, [(None, 0)]
        while stack:
            bound, node = stack.pop()
            # an equal score may still go before the last one by its id
            if bound is not None and len(best) == top and bound < -best[-1][0]:
                continue
            looked += 1
            a, z = self.doc_run[node]
            if z > a:
                scores = self._scores(self.docs, a, z, weights)
                floor = -best[-1][0] if len(best) == top else 1
                good = np.flatnonzero(scores >= max(1, floor))
                if len(good):
                    new = [(-int(scores[k]), i is None, i or 0) for k in good for i in self.ids[a + k]]
                    best = sorted(best + new)[:top]
            a, z = self.child_run[node]
            if z > a:
                bounds = self._scores(self.nodes, a, z, weights)
                floor = -best[-1][0] if len(best) == top else 1
                stack += [(int(bounds[k]), a + int(k)) for k in np.argsort(bounds, kind="stable") if bounds[k] >= max(1, floor)]
        return best, looked


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` best documents with a score above 0, ties by doc_id, nulls last.

    Rows of docs that share an id are documents of their own. Items of one id and one text are one item; those of one id
    and different texts are ranked each for itself. An item without terms, or whose terms no document holds, has no
    rows; nor has any if either table is empty. Scores are whole numbers below 2^63 as long as an item has fewer than
    10^8 terms.
    """
    spark = docs.sparkSession
    asked = term_vectors(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).distinct(), ["item_id"], "item_text")
    asked = materialise(asked.filter("n > 0").withColumn("_r", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    n_blocks, out = max(1, -(-size // ITEM_TERMS)), None
    for block in range(n_blocks):  # one, unless there are millions of items
        some = asked.filter(F.pmod(F.xxhash64("_r"), F.lit(n_blocks)) == block).collect()
        found = _search_block(docs, some, top, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    kind = items.schema[item_col].dataType.simpleString()
    return out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def _search_block(docs: DataFrame, items: list, top: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for r in items for t in r["terms"]}))}
    numbers = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vectors = materialise(term_vectors(rows, ["doc_id"], "text", numbers), "vectors")
    whole = vectors.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = whole["docs"], whole["terms"] or 0
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # the block's terms at most
        df[r["t"]] = r["df"]
    frequent = np.argsort(-df[:-1], kind="stable")
    place = np.empty(len(vocabulary), np.int64)
    place[frequent] = np.arange(len(vocabulary))  # a term's place in the paths: 0 is the most frequent
    asked = []
    for r in items:
        terms = np.array([vocabulary[bytes(t)] for t in r["terms"]], np.int64)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[t]) + 1))) if df[t] else 0 for t in terms], np.int64)
        asked.append((place[terms], weight * np.array(r["tfs"], np.int64)))
    shared = spark.sparkContext.broadcast((place, asked))

    def run(batches):
        place, asked = shared.value
        best: list[list] = [[] for _ in asked]
        weights, held = np.zeros(len(place) + 1, np.int64), []

        def look() -> None:
            tree = Tree(held, top)
            for k, (terms, w) in enumerate(asked):
                weights[terms] = w
                best[k], _ = tree.search(weights, best[k], top)
                weights[terms] = 0

        for b in batches:
            ids, n, terms, tfs = b.columns
            starts = terms.offsets.to_numpy()
            flat, counts = place[terms.values.to_numpy()], tfs.values.to_numpy()
            for i, (doc_id, length) in enumerate(zip(ids.to_pylist(), n.to_pylist(), strict=True)):
                a, z = starts[i], starts[i + 1]
                if a == z:
                    continue
                order = np.argsort(flat[a:z])
                m = 75 + (25 * length * n_docs) // n_terms
                held.append((flat[a:z][order].astype(">u4").tobytes(), counts[a:z][order].astype("<i8").tobytes(), m, doc_id))
                if len(held) >= SHARD:
                    look()
                    held = []
        if held:
            look()
        out = [(k, None if null else i, -low) for k, some in enumerate(best) for low, null, i in some]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    near = vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item long, doc_id long, score long")
    turn = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = near.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= top)
    told = spark.createDataFrame([(k, None if r["item_id"] is None else str(r["item_id"])) for k, r in enumerate(items)], "item long, item_id string")
    return ranked.join(F.broadcast(told), "item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LETTERS, _LETTERS.lower())
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
q AS (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, whole),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
