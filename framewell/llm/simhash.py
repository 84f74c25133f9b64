"""SimHash near-dedup: 64-bit fingerprints, BK-trees over shards of them, components of the links.

Fingerprints at 2 or fewer differing bits agree in at least 6 of 8 bytes, so every link lies inside one of the
28 shards that keep 6 given bytes. A shard holds distinct fingerprints only, and its members differ in 16 bits,
so its tree has at most 65,536 nodes whatever the corpus holds: that is the proven bound. A tree is sent where
its queries are (both come through one shuffle) instead of to every executor, since the trees of all shards
together grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import as_bytes, map_arrow, text_batches
from framewell.plans.components import connected_components
from framewell.plans.joins import skew_join, small
from framewell.session import materialise

RADIUS = 2
#: For each shard family the bits that its members share: all bytes but two.
FAMILIES = [sum(0xFF << 8 * k for k in range(8) if k not in gone) for gone in combinations(range(8), RADIUS)]


def fingerprint(data: bytes, shingle: int = 3, chunk: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half of the XXH64 (seed 42) of the word shingles."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        part = np.array([digest(joined[i:j], 42) for i, j in zip(starts[at : at + chunk], stops[at : at + chunk], strict=True)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def bk_tree(points: np.ndarray) -> list:
    """[fingerprint, {distance: subtree}] of distinct uint64 points; each child is keyed by its distance to the parent."""
    root: list = [points[0], {}]
    todo = [(root, points[1:])]
    while todo:
        node, rest = todo.pop()
        if len(rest):
            far = np.bitwise_count(rest ^ node[0])
            for d in np.unique(far).tolist():
                mine = rest[far == d]
                node[1][d] = child = [mine[0], {}]
                todo.append((child, mine[1:]))
    return root


def bk_links(tree: list, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within the radius. The queries go down together; at a node those go on along an edge
    whose distance to the node differs from the edge's by the radius at most (the triangle inequality)."""
    left, right, todo = [], [], [(tree, queries)]
    while todo:
        (point, children), some = todo.pop()
        far = np.bitwise_count(some ^ point).astype(np.int64)
        near = some[far <= radius]
        left.append(near)
        right.append(np.full(len(near), point))
        for d, child in children.items():
            some_on = some[np.abs(far - d) <= radius]
            if len(some_on):
                todo.append((child, some_on))
    return np.concatenate(left), np.concatenate(right)


def _roots(points: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Index of the first point of each point's component inside one shard."""
    i, j, root = np.searchsorted(points, left), np.searchsorted(points, right), np.arange(len(points))
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _shard_links(batches) -> Iterator[pa.RecordBatch]:
    """Rows (family, print), sorted by shard: links from each fingerprint to the first of its component in the shard."""
    masks = np.array(FAMILIES, np.uint64)
    kept_f, kept_p = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(family, prints):
        shard = prints & masks[family]
        cut = np.flatnonzero((np.diff(family) != 0) | (np.diff(shard) != 0)) + 1
        bounds = np.concatenate(([0], cut, [len(prints)]))
        wide = np.flatnonzero(np.diff(bounds) > 1)
        out = [[], []]
        for k in wide.tolist():
            points = np.unique(prints[bounds[k] : bounds[k + 1]])
            if len(points) > 1:
                root = points[_roots(points, *bk_links(bk_tree(points), points))]
                linked = root != points
                out[0].append(points[linked])
                out[1].append(root[linked])
        return [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in out]

    def batch(pair):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["src", "dst"])

    for b in batches:
        family = np.concatenate((kept_f, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
        prints = np.concatenate((kept_p, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(prints):
            continue
        shard = prints & masks[family]
        last = np.flatnonzero((family != family[-1]) | (shard != shard[-1]))
        end = last[-1] + 1 if len(last) else 0
        kept_f, kept_p = family[end:], prints[end:]
        yield batch(links(family[:end], prints[:end]))
    if len(kept_p):
        yield batch(links(kept_f, kept_p))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, print long) of every whole text; print is the signed view of the 64 bits. Null text has no words: zero."""

    text_batches(docs.sparkSession)

    def work(batch):
        prints = np.array([fingerprint(x, shingle) for x in as_bytes(batch.column(1))], np.uint64)
        yield {"id": batch.column(0), "print": prints.view(np.int64)}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, "id long, print long")


def print_links(prints: DataFrame) -> DataFrame:
    """(src, dst) links between distinct fingerprints of column print, enough of them to connect every component."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in FAMILIES])
    # dealt to all tasks again, since few short rows become 28 times as many
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select("print").distinct().repartition(tasks, "print")
    shards = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1))).alias("family"), "print")
    shard = F.col("print").bitwiseAND(F.element_at(masks, F.col("family") + 1))
    # hashed by shard, so each shard's rows meet in one task; a shard has 65,536 rows at most
    dealt = shards.repartition("family", shard).sortWithinPartitions("family", shard, "print")
    return dealt.mapInArrow(_shard_links, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row a document: id, print (long), component (the smallest id reachable by links, itself included).

    Nulls: a null text is linked like any text without words; a null id keeps its row and takes its component's
    smallest id. Repeated rows stay. Other columns are not read. An empty table gives an empty result.
    """
    own = materialise(fingerprints(docs, id_col, text_col, shingle), "prints")
    lowest = materialise(own.groupBy("print").agg(F.min("id").alias("low"), F.count("*").alias("rows")), "lowest")
    label = connected_components(print_links(lowest)).select(F.col("node").alias("print"), F.col("component").alias("rep"))
    known = lowest.join(label, "print", "left").select("print", "low", "rows", F.coalesce("rep", "print").alias("rep"))
    known = materialise(known, "known")
    least = known.groupBy("rep").agg(F.min("low").alias("component"), F.count("*").alias("prints"))
    by_print = skew_join(known, least, "rep", "prints").select("print", "component", "rows")
    return skew_join(own, by_print, "print", "rows").select("id", "print", "component")


def _text_key(text_col: str) -> list[Column]:
    """128 bits of the text in two columns, text_a and text_b."""
    return [F.xxhash64(F.col(text_col)).alias("text_a"), F.xxhash64(F.lit(1), F.col(text_col)).alias("text_b")]


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of `similar_documents`: the one with the smallest id, null ids last, and of rows
    that repeat the id the one whose text's hash is smallest, then whose columns are."""
    row = ["id", "text_a", "text_b"]
    once = materialise(groups.groupBy("group", *row).agg(F.count("*").alias("n")), "rows")
    first = once.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), *row)).alias("k"), F.count("*").alias("of"))
    told = skew_join(once, first, "group", "of").select(*[F.col(c).alias(f"_{c}") for c in row], "n", F.struct(F.col("id").isNull().alias("last"), *row).eqNullSafe(F.col("k")).alias("stays"))
    told = materialise(told, "told")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), *_text_key(text_col))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_a") == F.col("_text_a")) & (F.col("text_b") == F.col("_text_b"))
    # what goes is less than what stays, and rows that repeat an id and a text are few: both are looked up by broadcast
    # where they are, and the texts stay where they are
    apart = told.filter(~F.col("stays") | (F.col("n") > 1)).select(*[f"_{c}" for c in row])
    alone = rows.join(small(materialise(apart, "apart")), same, "left_anti").select("row.*")
    several = materialise(told.filter(F.col("stays") & (F.col("n") > 1)).select(*[f"_{c}" for c in row]), "several")
    if several.isEmpty():
        return alone
    repeated = rows.join(small(several), same, "left_semi").groupBy(*row).agg(F.min("row").alias("row")).select("row.*")
    return alone.unionByName(repeated)


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# Similarity of 0.8 or more, for stages without a contract of their own.

#: 64-bit words of a wide fingerprint, bits of a table's key, nodes of a shard that needs no tree.
WIDE, KEY_BITS, FEW = 4, 16, 8
#: Words of a long fingerprint, which is told for nodes that have a candidate, and standard deviations beyond the expected
#: distance up to which nodes are candidates by the wide and by the long one.
LONG, MARGIN, LONG_MARGIN = 32, 3.0, 2.0
#: Nodes of a shard from which on it first meets its middle alone, sets that one task compares with a node's, and
#: shingles of a part of a shard that is cut in parts, which are 4,096 at most.
MIDDLE, COMPARED, HELD, PARTS = 512, 500, 4_000_000, 1 << 12


def shingle_hashes(data: bytes, shingle: int = 5) -> np.ndarray:
    """The set of a text's word shingles (fewer words: the whole sequence) as sorted XXH64; empty without words."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends, n = np.cumsum(size), max(1, len(words) - shingle + 1)
    starts, stops = (ends - size)[:n].tolist(), (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)], np.uint64))


def wide_bits(hashes: np.ndarray, words: int = WIDE) -> np.ndarray:
    """64 bits a word: each set where over half of the distinct shingles' hashes, spread by a multiplier a word, have it.

    Two texts whose shingle sets have similarity J differ in a share of acos(2J / (1 + J)) / pi of the bits, about.
    """
    out = np.zeros(words, np.uint64)
    for k in range(words if len(hashes) else 0):
        spread = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        spread = (spread ^ (spread >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        spread ^= spread >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(spread), 1 << 16):
            ones += np.unpackbits(spread[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(spread), bitorder="little").view("<u8")[0]
    return out


def wide_radius(similarity: float, margin: float = 0.0, words: int = WIDE) -> int:
    """Differing bits that texts of this similarity have, about, and so many standard deviations more."""
    share = float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    return round(64 * words * share + margin * (64 * words * share * (1 - share)) ** 0.5)


def tables_for(similarity: float, rows: int, recall: float = 0.98) -> tuple[int, int]:
    """(tables, bits of a key): keys get a bit more each time the rows double beyond a million, and tables to keep the recall."""
    bits = max(KEY_BITS, (max(1, rows) - 1).bit_length() - 4)
    same = (1 - wide_radius(similarity) / (64 * WIDE)) ** bits
    return int(np.ceil(np.log(1 - recall) / np.log(1 - same))), bits


def _places(tables: int, bits: int) -> np.ndarray:
    """The bits that each table's key samples."""
    rng = np.random.default_rng(20)
    return np.stack([rng.choice(64 * WIDE, bits, replace=False) for _ in range(tables)])


def _keys(tables: int, bits: int):
    """mapInArrow work: the row with its key in each table before it; a key is a sample of the bits, after the table's
    number. The row's first columns are node, size and the words."""
    places = _places(tables, bits)

    def run(batches):
        for b in batches:
            words = np.stack([b.column(k + 2).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(WIDE)], axis=1)
            ones = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
            for t in range(tables):
                key = ones[:, places[t]].astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64)) + (np.int64(t) << bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", *b.schema.names])

    return run


class Shards:
    """Nodes of shards in order: key, node, size of the shingle set, words, component, the candidate (distance, node) up to
    which a node has been compared, and, where they are known, the long fingerprint, and the side on which a node stands
    where two parts of a shard meet (0: all of one part meet each other)."""

    def __init__(self, columns: list[np.ndarray]) -> None:
        self.key, self.node, self.size = columns[:3]
        self.words = np.stack([c.view(np.uint64) for c in columns[3 : 3 + WIDE]], axis=1)
        self.component, self.far, self.other = columns[3 + WIDE : 6 + WIDE]
        self.long = np.frombuffer(b"".join(columns[6 + WIDE]), np.uint64).reshape(len(self.key), LONG) if len(columns) > 6 + WIDE else None
        self.side = columns[7 + WIDE] if len(columns) > 7 + WIDE else None

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the shards begin, and their sizes."""
        starts = np.concatenate(([0], np.flatnonzero(np.diff(self.key)) + 1)) if len(self.key) else np.empty(0, np.int64)
        return starts, np.diff(np.append(starts, len(self.key)))

    def distance(self, i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        return np.bitwise_count(self.words[i] ^ self.words[j]).sum(axis=-1, dtype=np.int64)

    def fit(self, i: np.ndarray, j: np.ndarray | int, near: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the near ones can be alike with sets of their size and by their long fingerprints, and are not known to
        be in one component."""
        a, b = self.size[i], self.size[j]
        on = near & (np.minimum(a, b) >= similarity * np.maximum(a, b)) & (self.component[i] != self.component[j])
        if self.side is not None:
            on &= (self.side[i] == 0) | (self.side[i] != self.side[j])
        if self.long is not None:
            k = np.flatnonzero(on)
            far = np.bitwise_count(self.long[i[k]] ^ self.long[j if np.isscalar(j) else j[k]]).sum(axis=-1, dtype=np.int64)
            on[k[far > wide_radius(similarity, LONG_MARGIN, LONG)]] = False
        return on


def tree_of(shards: Shards, places: np.ndarray) -> list:
    """BK-tree of the places: [place, {distance: subtree}]."""
    tree = [int(places[0]), {}]
    todo = [(tree, places[1:])]
    while todo:
        node, rest = todo.pop()
        if len(rest):
            far = shards.distance(rest, node[0])
            for d in np.unique(far).tolist():
                mine = rest[far == d]
                node[1][d] = child = [int(mine[0]), {}]
                todo.append((child, mine[1:]))
    return tree


def nearest(q: np.ndarray, far: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k smallest (far, other) of their q."""
    order = np.lexsort((other, far, q))
    q = q[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _few_pairs(s: Shards, sizes: np.ndarray, radius: int, similarity: float) -> Iterator[tuple]:
    """(i, j, distance), i first, of near nodes in shards of few: a tree prunes nothing there, so they are compared side by side, all at once."""
    few = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    for step in range(1, FEW):
        i = np.flatnonzero(few[:-step] & (s.key[:-step] == s.key[step:])) if len(s.key) > step else np.empty(0, np.int64)
        far = s.distance(i, i + step)
        on = s.fit(i, i + step, far <= radius, similarity)
        yield i[on], i[on] + step, far[on]


def _tree_pairs(s: Shards, a: int, z: int, radius: int, similarity: float) -> Iterator[tuple]:
    """(i, j, distance), each pair both ways, of near nodes in [a, z), by a BK-tree of all nodes but those of the largest
    component, which need no comparison with each other."""
    places = np.arange(a, z)
    names, of, many = np.unique(s.component[a:z], return_inverse=True, return_counts=True)
    large = of == many.argmax()
    todo = [] if len(names) == 1 else [(tree_of(s, places[~large]), places)]
    while todo:
        (place, children), some = todo.pop()
        far = s.distance(some, place)
        on = s.fit(some, place, far <= radius, similarity)
        q, o, d = some[on], np.full(on.sum(), place), far[on]
        back = large[q - a]
        yield np.append(q, o[back]), np.append(o, q[back]), np.append(d, d[back])
        for d, child in children.items():
            on = some[np.abs(far - d) <= radius]
            if len(on):
                todo.append((child, on))


def _whole_shards(batches) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by the first one, cut between its values only."""
    held: list[list] = []

    def joined(parts):
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not held or columns[0][-1] != held[-1][0][-1]:
            end = int(np.searchsorted(columns[0], columns[0][-1]))
            if held or end:
                yield joined([*held, [c[:end] for c in columns]])
            held, columns = [], [c[end:] for c in columns]
        held.append(columns)
    if held:
        yield joined(held)


def _candidates(radius: int, similarity: float, k: int, middles: bool):
    """mapInArrow work over rows sorted by key: (node, other, far), for each node of a shard the k nearest of other
    components beyond those it has been compared with. With `middles` the nodes of a large shard get the node nearest
    to its majority bits instead, and a row without other, which tells that more may be near."""

    def beyond(s: Shards, q, o, far):
        on = (far > s.far[q]) | ((far == s.far[q]) & (s.node[o] > s.other[q]))
        q, o, far = q[on], o[on], far[on]
        best = nearest(q, far, s.node[o], k)
        return q[best], o[best], far[best]

    def by_tree(s: Shards, a: int, z: int):
        found, held = [(np.empty(0, np.int64),) * 3], 0
        for pairs in _tree_pairs(s, a, z, radius, similarity):
            found.append(pairs)
            held += len(pairs[0])
            if held > 1_000_000:  # the nearest stay as pairs come, so a dense shard holds few of them
                found = [beyond(s, *(np.concatenate(x) for x in zip(*found, strict=True)))]
                held = len(found[0][0]) - 1_000_000
        return beyond(s, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def by_middle(s: Shards, a: int, z: int):
        ones = np.zeros(64 * WIDE, np.int64)
        for at in range(a, z, 1 << 14):
            ones += np.unpackbits(np.ascontiguousarray(s.words[at : min(z, at + (1 << 14))]).view(np.uint8).reshape(-1, 8 * WIDE), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * ones > z - a, bitorder="little").view("<u8")
        places = np.arange(a, z)
        hub = a + int(np.bitwise_count(s.words[a:z] ^ middle).sum(axis=1, dtype=np.int64).argmin())
        far = s.distance(places, hub)
        on = s.fit(places, hub, far <= radius, similarity)
        return places[on], np.full(on.sum(), hub), far[on]

    def told(s: Shards):
        starts, sizes = s.runs()
        pairs = [x for i, j, far in _few_pairs(s, sizes, radius, similarity) for x in ((i, j, far), (j, i, far))]
        out, more = [beyond(s, *(np.concatenate(x) for x in zip(*pairs, strict=True)))], []
        for n in np.flatnonzero(sizes > FEW).tolist():
            a, z = int(starts[n]), int(starts[n] + sizes[n])
            if middles and sizes[n] > MIDDLE:
                out.append(by_middle(s, a, z))
                more.append(s.node[a:z])
            else:
                out.append(by_tree(s, a, z))
        q, o, far = (np.concatenate(x) for x in zip(*out, strict=True))
        more = np.concatenate([*more, np.empty(0, np.int64)])
        none = pa.nulls(len(more), pa.int64())
        columns = [pa.chunked_array([pa.array(x), y], pa.int64()).combine_chunks() for x, y in ((s.node[q], pa.array(more)), (s.node[o], none), (far, none))]
        return pa.RecordBatch.from_arrays(columns, names=["node", "other", "far"])

    def run(batches):
        for columns in _whole_shards(batches):
            yield told(Shards(columns))

    return run


def _cells(keyed: DataFrame, live: DataFrame, tables: int, bits: int) -> DataFrame:
    """The keyed rows with their cell and side: a shard, or where it has much to compare, two of its parts that meet.

    What a shard compares are the pairs of different components, so one that is a single group stays whole.
    """
    thin = live.select("node", "size", *[f"w{k}" for k in range(WIDE)], "component")
    thin = thin.mapInArrow(_keys(tables, bits), ", ".join(f"{n} long" for n in ("key", *thin.columns))).groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    of = thin.groupBy("key").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("same"), F.sum("held").alias("held"), F.count("*").alias("many"))
    parts = F.greatest(F.ceil(F.sqrt(F.col("n") * F.col("n") - F.col("same")) / COMPARED), F.ceil(F.col("held") / HELD))
    crowded = materialise(of.filter("many > 1").select(F.col("key").alias("_key"), F.least(parts, F.lit(PARTS)).cast("int").alias("parts")).filter("parts > 1"), "crowded")
    own = keyed.join(small(crowded), F.col("key") == F.col("_key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    met = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    cell = (F.col("key") * PARTS + F.least("part", "with")) * PARTS + F.greatest("part", "with")
    side = F.when(F.col("part") == F.col("with"), 0).when(F.col("part") < F.col("with"), 1).otherwise(2)
    return met.select(cell.alias("cell"), *[c for c in keyed.columns if c != "key"], side.cast("long").alias("side"))


def _undecided(s: Shards, radius: int, similarity: float, sampled: np.ndarray, bits: int) -> Iterator[tuple]:
    """(i, j) of near nodes that have not been compared yet, nearest first in some thousand pairs, each pair in the first
    table alone where both have one key (sampled: a row a table, 1 at the bits of its key)."""
    starts, sizes = s.runs()
    large = np.flatnonzero(sizes > FEW).tolist()
    trees = (x for n in large for x in _tree_pairs(s, int(starts[n]), int(starts[n] + sizes[n]), radius, similarity))

    def asked(i, j, far):
        return (far < s.far[i]) | ((far == s.far[i]) & (s.node[j] <= s.other[i]))

    def settled(found):
        i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
        on = ~asked(i, j, far) & ~asked(j, i, far)
        i, j, far = i[on], j[on], far[on]
        differ = np.unpackbits((s.words[i] ^ s.words[j]).view(np.uint8).reshape(-1, 8 * WIDE), axis=1, bitorder="little").astype(np.float32)
        on = (differ @ sampled.T == 0).argmax(axis=1) == s.key[i] // (PARTS * PARTS) >> bits
        order = np.argsort(far[on], kind="stable")
        return i[on][order], j[on][order]

    found, held = [], 0
    for i, j, far in chain(_few_pairs(s, sizes, radius, similarity), trees):
        on = i < j
        if on.any():
            found.append((i[on], j[on], far[on]))
            held += len(found[-1][0])
        if held > 1 << 14:
            yield settled(found)
            found, held = [], 0
    if found:
        yield settled(found)


def _sampled(tables: int, bits: int) -> np.ndarray:
    out = np.zeros((tables, 64 * WIDE), np.float32)
    np.put_along_axis(out, _places(tables, bits), 1, axis=1)
    return out


def _pending(radius: int, similarity: float, tables: int, bits: int):
    """mapInArrow work over rows sorted by cell: (cell, node, side) of the nodes that have something to compare there, a row each."""
    sampled = _sampled(tables, bits)

    def run(batches):
        for columns in _whole_shards(batches):
            s = Shards(columns)
            on = np.zeros(len(s.key), bool)
            for i, j in _undecided(s, radius, similarity, sampled, bits):
                on[i] = on[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (s.key, s.node, s.side)], names=["cell", "node", "side"])

    return run


def _joined(radius: int, similarity: float, tables: int, bits: int):
    """mapInArrow work over rows sorted by cell, with the nodes' whole sets at the end: (src, dst), links that join
    components. Pairs that links of the task have joined already are not compared, so there are fewer links than nodes."""
    sampled = _sampled(tables, bits)

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for columns in _whole_shards(batches):
            s, sets = Shards(columns[:-1]), columns[-1]
            out: list[list] = [[], []]
            for i, j in _undecided(s, radius, similarity, sampled, bits):
                before = len(out[0])
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    a, b = find(int(s.component[x])), find(int(s.component[y]))
                    if a != b and similar(np.frombuffer(sets[x], np.uint64), np.frombuffer(sets[y], np.uint64), similarity):
                        root[a] = b
                        out[0].append(int(s.node[x]))
                        out[1].append(int(s.node[y]))
                if len(out[0]) > before:
                    s.component = np.array([find(c) for c in s.component.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["src", "dst"])

    return run


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _sets(docs: DataFrame, text_col: str, nodes: DataFrame, work, schema: str) -> DataFrame:
    """(node, what work makes of its text's bytes) for nodes (node, text_a, text_b): each is told from one of its texts."""
    keyed = docs.select(F.col(text_col).alias("text"), *_text_key(text_col)).join(small(nodes), ["text_a", "text_b"])

    def run(batch):
        yield {"node": batch.column(0), schema.split()[0]: pa.array([*map(work, as_bytes(batch.column(1)))], pa.binary())}

    return map_arrow(keyed.groupBy("node").agg(F.min("text").alias("text")), run, f"node long, {schema}")


def _verified(pairs: DataFrame, texts: DataFrame, sets_of, similarity: float) -> DataFrame:
    """(src, dst): the pairs (node, other) whose whole sets of shingles have the similarity.

    Sets of the nodes that pairs name come from one text each (a node's texts have one set; texts: node, text_a, text_b).
    The pairs of a node that many others name are dealt to several tasks, each with its set.
    """
    pairs = pairs.groupBy(F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high")).agg(F.min("node").alias("a"))
    pairs = materialise(pairs.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")), "pairs")
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    need = materialise(texts.join(need, "node"), "named")
    grams = materialise(sets_of(need).withColumnRenamed("node", "of"), "sets")
    hot = materialise(pairs.groupBy(F.col("b").alias("_hot")).agg(F.count("*").alias("n")).filter(F.col("n") > COMPARED), "hubs")
    parts = F.coalesce(F.ceil(F.col("n") / COMPARED), F.lit(1))
    dealt = pairs.join(small(hot), F.col("b") == F.col("_hot"), "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("part"))
    mine = dealt.join(grams, F.col("a") == F.col("of")).select("b", "part", "a", "grams")
    its = dealt.select("b", "part").distinct().join(grams, F.col("b") == F.col("of")).select("b", "part", F.lit(None).cast("long").alias("a"), "grams")
    met = mine.unionByName(its).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches):
        held = None
        for batch in batches:
            out: list[list] = [[], []]
            for b, a, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                some = np.frombuffer(data, np.uint64)
                if a is None:
                    held = some
                    continue
                if similar(held, some, similarity):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["src", "dst"])

    return met.mapInArrow(run, "src long, dst long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row a document: id, component (the smallest id reachable over links of the given similarity, itself included),
    group (the component's own key, there without any id too), text_a and text_b (128 bits of the text).

    Texts with equal sets of word shingles are one node. Two nodes are linked if their sets have the similarity; that is
    told from the whole sets, and only for candidates. These are searched by wide fingerprints in tables whose keys are
    samples of the bits, each bucket a shard with a BK-tree of its own; tables are as many as find a link of just this
    similarity with 98 per cent, closer ones more surely. Nodes that have candidates get a long fingerprint, by which
    most of those below the similarity fall away, some 2 % of true links among them. First each node is compared with its
    nearest candidate, which joins a group of copies by few comparisons. Then the nodes that have candidates in other
    components come to the buckets where these are, with their whole sets, and are compared there: rows are nodes of
    buckets and links that join components, never pairs. Null and empty texts are alike.
    """
    text_batches(docs.sparkSession)
    names = [f"w{k}" for k in range(WIDE)]

    def work(batch):
        found = [shingle_hashes(x, shingle) for x in as_bytes(batch.column(1))]
        wide = np.stack([*map(wide_bits, found), np.zeros(WIDE, np.uint64)])[:-1]
        nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
        yield {"id": batch.column(0), "text_a": batch.column(2), "text_b": batch.column(3), "node": nodes, "size": np.array([*map(len, found)], np.int64), **{n: np.ascontiguousarray(wide[:, k]).view(np.int64) for k, n in enumerate(names)}}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *_text_key(text_col))
    own = map_arrow(rows, work, "id long, text_a long, text_b long, node long, size long, " + ", ".join(f"{n} long" for n in names))
    own = materialise(own, "wide")
    known = materialise(own.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("rows"), F.min(F.struct("text_a", "text_b")).alias("key"), *[F.first(n).alias(n) for n in ("size", *names)]), "nodes")
    tables, bits = tables_for(similarity, known.count())
    radius, columns = wide_radius(similarity, MARGIN), ["node", "size", *names]
    more = ["component long", "seen_far long", "seen long", "long binary"]
    texts = known.select("node", "key.text_a", "key.text_b")

    def grams_of(nodes):
        return _sets(docs, text_col, nodes, lambda x: shingle_hashes(x, shingle).tobytes(), "grams binary")

    nodes = known.filter("size > 0").select(*columns)
    keyed = nodes.mapInArrow(_keys(tables, bits), ", ".join(f"{n} long" for n in ("key", *columns)))
    dealt = keyed.repartition("key").sortWithinPartitions("key")  # constant columns are not shuffled
    dealt = dealt.select("*", F.col("node").alias("component"), F.lit(-1).cast("long").alias("seen_far"), F.lit(0).cast("long").alias("seen"))
    found = dealt.mapInArrow(_candidates(radius, similarity, 1, True), "node long, other long, far long")
    pick = F.min(F.when(F.col("other").isNotNull(), F.struct("far", "other")))
    asked = materialise(found.groupBy("node").agg(pick.alias("p"), F.max(F.col("other").isNull()).alias("open")), "asked")
    edges = materialise(_verified(asked.filter("p is not null").select("node", "p.other"), texts, grams_of, similarity), "links")
    label = materialise(connected_components(edges), "label")

    # what else is near is compared where it meets; one that met a large shard's middle alone may have nearer ones
    long = materialise(_sets(docs, text_col, materialise(texts.join(asked.select("node"), "node"), "asking"), lambda x: wide_bits(shingle_hashes(x, shingle), LONG).tobytes(), "long binary"), "long")
    seen = asked.select("node", F.when(F.col("open"), -1).otherwise(F.col("p.far")).cast("long").alias("seen_far"), F.when(F.col("open"), 0).otherwise(F.col("p.other")).cast("long").alias("seen"))
    live = nodes.join(seen, "node").join(long, "node").join(label, "node", "left").select(*columns, F.coalesce("component", "node").alias("component"), "seen_far", "seen", "long")
    live = materialise(live, "live")
    keyed = live.mapInArrow(_keys(tables, bits), ", ".join([*[f"{n} long" for n in ("key", *columns)], *more]))
    cells = _cells(keyed, live, tables, bits).select("cell", *live.columns, "side").repartition("cell").sortWithinPartitions("cell")
    pending = materialise(cells.mapInArrow(_pending(radius, similarity, tables, bits), "cell long, node long, side long"), "pending")
    sets = materialise(grams_of(materialise(texts.join(pending.select("node").distinct(), "node"), "named")), "sets")
    met = pending.join(live, "node").join(sets, "node").select("cell", *live.columns, "side", "grams").repartition("cell").sortWithinPartitions("cell")
    joined = materialise(met.mapInArrow(_joined(radius, similarity, tables, bits), "src long, dst long"), "joined")
    if not joined.isEmpty():
        label = materialise(connected_components(edges.unionByName(joined)), "label")
    told = known.select("node", "low", "rows").join(label.withColumnRenamed("component", "rep"), "node", "left").select("node", "low", "rows", F.coalesce("rep", "node").alias("rep"))
    told = materialise(told, "known")
    least = told.groupBy("rep").agg(F.min("low").alias("component"), F.count("*").alias("nodes"))
    named = skew_join(told, least, "rep", "nodes").select("node", "component", F.col("rep").alias("group"), "rows")
    return skew_join(own.select("id", "text_a", "text_b", "node"), named, "node", "rows").select("id", "component", "group", "text_a", "text_b")
