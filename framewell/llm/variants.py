"""Spelling variants: words of a vocabulary that one inserted, deleted or replaced code point turns into each other.

One error leaves one half of a word as it is. So a word is searched twice: its first half is matched exactly from the
word's beginning and then extended to the right, its second half from the word's end and then to the left, each over the
other half with one error; a word that is found both ways counts the first way. The searches run in bidirectional
FM-indexes of vocabulary shards, `$word$word$`: intervals of suffix ranks of the text and of the text reversed, kept in
step, all searches of a shard side by side in arrays. A word is dealt to the shards where words that could ask for it
search: by its beginnings and endings of the lengths that halves of words a code point shorter, as long, or a code point
longer have. Endings and beginnings that very many words share are cut into several shards, and the words that search
there go to each. A shard sends, for each word that asked, the number of its near words and the best of them, not pairs.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import text_batches
from framewell.plans.components import settle
from framewell.plans.joins import small
from framewell.session import materialise

SHORTEST, OCCURRENCES = 5, 3
#: A word that occurs so many times as often as a near one is that one's form.
RATIO = 2
#: One run in so many loses a code point.
EDITED = 97
#: Code points of the words of a shard about, and of those that share a beginning or an ending before they are cut.
SHARD = 65_536
#: Symbols of an index between two places where all ranks are stored.
STEP = 16
_LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
# Latin-1 letters with A-Z in lower case, all else a blank
_LATIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0xC0 or 97 <= c <= 122 else 32 for c in range(256))


def edited_runs(doc_id: int | None, text: str) -> dict[str, int]:
    """Runs of letters of a text, lower-cased in A-Z, with one in EDITED shortened by a code point, and their counts."""
    found: dict[bytes, int] = {}
    for run in text.encode("latin-1", "replace").translate(_LATIN).split():
        found[run] = found.get(run, 0) + 1
    out: dict[str, int] = {}
    head = f"{'' if doc_id is None else doc_id}:".encode()
    for run, n in found.items():
        word = run.decode("latin-1")
        h = zlib.crc32(head + (run if word.isascii() else word.encode()))
        if h % EDITED == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        out[word] = out.get(word, 0) + n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of all texts. A null text has no word; a null id stands as an empty one."""
    text_batches(docs.sparkSession)

    def run(batches):
        count: dict[str, int] = {}
        for b in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for word, n in edited_runs(doc_id, text or "").items():
                    if len(word) >= shortest:
                        count[word] = count.get(word, 0) + n
            if len(count) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array([*count], pa.string()), pa.array([*count.values()], pa.int64())], names=["word", "n"])
                count = {}
        yield pa.RecordBatch.from_arrays([pa.array([*count], pa.string()), pa.array([*count.values()], pa.int64())], names=["word", "n"])

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by doubling; a suffix that ends goes before those that go on."""
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1 if step < len(rank) else 0
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.append(0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        rank, step = new, step * 2
        if step >= len(rank) or rank[order[-1]] == len(rank) - 1:
            return order


class Ranks:
    """How often each symbol stands among the first i of a sequence, stored at each STEP symbols."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        n = len(symbols)
        self.kinds = kinds
        self.padded = np.full((n // STEP + 1, STEP), kinds, np.int32)
        self.padded.reshape(-1)[:n] = symbols
        here = np.zeros((len(self.padded), kinds), np.int32)
        block = np.arange(n) // STEP
        np.add.at(here, (block, symbols), 1)
        self.stored = np.vstack([np.zeros((1, kinds), np.int32), np.cumsum(here, axis=0, dtype=np.int32)])

    def every(self, i: np.ndarray) -> np.ndarray:
        """A row of counts of all symbols for each i."""
        block, left = i // STEP, i % STEP
        block = np.minimum(block, len(self.padded) - 1)
        left = i - block * STEP
        out = self.stored[block].astype(np.int64)
        near = self.padded[block]
        for k in range(STEP):
            on = np.flatnonzero(left > k)
            out[on, near[on, k]] += 1
        return out


class FMIndex:
    """Bidirectional: an interval is (low, low reversed, size), of suffixes that begin with a pattern, and of suffixes of
    the reversed text that begin with the pattern reversed. Symbol 0 parts words; the words are of symbols from 1."""

    def __init__(self, words: list[np.ndarray], kinds: int) -> None:
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(np.append(0, sizes + 1))
        text = np.zeros(int(starts[-1]) + 1, np.int64)
        self.number = np.full(len(text), -1, np.int64)  # of the word that begins after a place
        self.number[starts[:-1]] = np.arange(len(words))
        for w, a in zip(words, starts[:-1], strict=True):
            text[a + 1 : a + 1 + len(w)] = w
        self.kinds, n = kinds, len(text)
        self.order = suffix_array(text)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=kinds)))[:kinds]
        self.total = np.bincount(text, minlength=kinds)
        # the text is read as a ring: what stands before its first place is its last
        self.left = Ranks(text[self.order - 1], kinds)
        back = text[::-1]
        self.right = Ranks(back[suffix_array(back) - 1], kinds)
        self.size = n

    def of_separator(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.total[0], np.int64)

    def extend(self, at: tuple, to_left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of every pattern with each symbol before it (after it, if not to_left): a row of symbols each."""
        low, other, size = at if to_left else (at[1], at[0], at[2])
        ranks = self.left if to_left else self.right
        a, b = ranks.every(low), ranks.every(low + size)
        new, count = self.first + a, b - a
        aside = other[:, None] + np.cumsum(count, axis=1) - count
        return (new, aside, count) if to_left else (aside, new, count)

    def step(self, at: tuple, symbols: np.ndarray, to_left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.arange(len(symbols))
        return tuple(x[rows, symbols] for x in self.extend(at, to_left))


def one_error(index: FMIndex, words: list[np.ndarray], to_left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asking, found): each word of the index that words[asking] becomes by one error outside the half that stands.

    to_left: the second half stands, and the error is before it; else the first half, and the error is after it.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    exact = lengths - lengths // 2 if to_left else lengths // 2
    # in reading order, from the end of the word that stands; 0, the separator, past the other end
    table = np.zeros((len(words), int(lengths.max()) + 2), np.int64)
    for k, w in enumerate(words):
        table[k, : len(w)] = w[::-1] if to_left else w
    alive, at = np.arange(len(words)), index.of_separator(len(words))
    who, place, since = np.empty(0, np.int64), np.empty(0, np.int64), tuple(np.empty(0, np.int64) for _ in range(3))
    asking, found, k = [], [], 0
    while len(alive) or len(who):
        new = [(who, place, since)]
        if len(alive):
            every, reading = index.extend(at, to_left), table[alive, k]
            open_ = exact[alive] <= k
            row, symbol = np.nonzero((every[2] > 0) & open_[:, None] & (np.arange(index.kinds) != reading[:, None]))
            row, symbol = row[symbol > 0], symbol[symbol > 0]
            other = tuple(x[row, symbol] for x in every)
            asks, inside = alive[row], reading[row] > 0
            new.append((asks[inside], np.full(int(inside.sum()), k + 1), tuple(x[inside] for x in other)))  # replaced
            new.append((asks, np.full(len(row), k), other))  # one more; an equal one is taken at the end of its run
            less = open_ & (reading > 0) & (reading != table[alive, k + 1]) & (lengths[alive] > 1)  # one less, the last of its run
            new.append((alive[less], np.full(int(less.sum()), k + 1), tuple(x[less] for x in at)))
            going = np.flatnonzero((reading > 0) & (every[2][np.arange(len(alive)), reading] > 0))
            at, alive = tuple(x[going, reading[going]] for x in every), alive[going]
            k += 1
        who, place = (np.concatenate([x[j] for x in new]) for j in (0, 1))
        since = tuple(np.concatenate([x[2][j] for x in new]) for j in range(3))
        if len(who):
            since = index.step(since, table[who, place], to_left)
            ended = (since[2] > 0) & (place == lengths[who])
            asking.append(who[ended])
            found.append(index.number[index.order[since[0][ended]]])
            on = (since[2] > 0) & ~ended
            who, place, since = who[on], place[on] + 1, tuple(x[on] for x in since)
    return (np.concatenate(asking), np.concatenate(found)) if asking else (np.empty(0, np.int64), np.empty(0, np.int64))


def _chunks(words: list[np.ndarray], most: int = 1024, cells: int = 1 << 20):
    """Places of the words, by length, in runs that fit a table."""
    order, run, longest = sorted(range(len(words)), key=lambda k: len(words[k])), [], 0
    for k in order:
        longest = len(words[k]) + 2
        if run and (len(run) >= most or longest * (len(run) + 1) > cells):
            yield run
            run = []
        run.append(k)
    if run:
        yield run


def _search(table: pa.Table) -> pa.Table:
    """One shard: (word, n_near, best_n, best) of the words that ask and have near words in it."""
    columns = {c: table.column(c).to_pylist() for c in ("word", "n", "to_left", "held", "asks")}
    held = {w: n for w, n, h in zip(columns["word"], columns["n"], columns["held"], strict=True) if h}
    known, counts = sorted(held), np.array([held[w] for w in sorted(held)], np.int64)
    ask = [(w, left) for w, left, a in zip(columns["word"], columns["to_left"], columns["asks"], strict=True) if a]
    out: list[list] = [[], [], [], []]
    if known and ask:
        letters = {c: k for k, c in enumerate(sorted({c for w in known for c in w} | {c for w, _ in ask for c in w}), 1)}
        index = FMIndex([np.fromiter(map(letters.get, w), np.int64, len(w)) for w in known], len(letters) + 1)
        for left in (False, True):
            asking = [w for w, x in ask if x == left]
            coded = [np.fromiter(map(letters.get, w), np.int64, len(w)) for w in asking]
            for run in _chunks(coded):
                who, found = one_error(index, [coded[k] for k in run], left)
                who = np.array(run)[who]
                if left:  # what has the first half as well was found from there
                    apart = [known[v][: len(asking[u]) // 2] != asking[u][: len(asking[u]) // 2] for u, v in zip(who.tolist(), found.tolist(), strict=True)]
                    who, found = who[np.array(apart, bool)], found[np.array(apart, bool)]
                order = np.lexsort((found, -counts[found], who))  # known is in order of code points
                who, found = who[order], found[order]
                first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.empty(0, np.int64)
                for a, z in zip(first.tolist(), [*first[1:].tolist(), len(who)], strict=True) if len(first) else ():
                    for column, x in zip(out, (asking[who[a]], z - a, int(counts[found[a]]), known[found[a]]), strict=True):
                        column.append(x)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of each word with near ones: how many there are and which of them occurs most.

    words: (word, n), each word once. Ties go to the smallest word in the order of code points. All near words of the
    table count; words of any length are taken, an empty or null one is near to none.
    """
    keyed = words.filter("word <> ''").select(
        "word", "n", F.char_length("word").alias("size"),
        F.expr("array_distinct(flatten(transform(array(-1, 0, 1), d -> array("
               "named_struct('to_left', false, 'key', left(word, (char_length(word) + d) div 2)),"
               "named_struct('to_left', true, 'key', right(word, (char_length(word) + d + 1) div 2))))))").alias("keys"),
    )
    keyed = keyed.select("word", "n", "size", F.explode("keys").alias("k")).select("word", "n", "size", "k.to_left", "k.key")
    asks = F.char_length("key") == F.when(F.col("to_left"), F.expr("(size + 1) div 2")).otherwise(F.expr("size div 2"))
    rows = materialise(keyed.withColumn("asks", asks), "keyed")
    sizes = materialise(rows.groupBy("to_left", "key").agg(F.sum("size").alias("chars")), "keys")
    total = sizes.agg(F.sum("chars").alias("n")).first()["n"] or 0
    hot = materialise(sizes.filter(F.col("chars") > SHARD).select("to_left", "key", F.ceil(F.col("chars") / SHARD).cast("int").alias("parts")), "hot")
    told = rows.join(small(hot), ["to_left", "key"], "left")
    cold = told.filter("parts is null").select(F.pmod(F.xxhash64("to_left", "key"), F.lit(max(1, -(-total // SHARD)))).alias("shard"), F.lit(None).cast("string").alias("key"), "to_left", "word", "n", F.lit(True).alias("held"), "asks")
    many = told.filter("parts is not null")
    own = F.pmod(F.xxhash64("word"), F.col("parts").cast("long"))
    mine = many.select(own.alias("shard"), "key", "to_left", "word", "n", F.lit(True).alias("held"), F.lit(False).alias("asks"))
    guests = many.filter("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("shard"), "key", "to_left", "word", "n", F.lit(False).alias("held"), "asks")
    dealt = cold.unionByName(mine).unionByName(guests)
    # words of one hot beginning and of one hot ending don't share a shard: a word would be found in two
    side = F.when(F.col("key").isNotNull(), F.col("to_left")).alias("side")
    found = dealt.groupBy("shard", "key", side).applyInArrow(lambda table: _search(table), "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words (word, n; each word once).

    form: the near word that occurs most, if that is `ratio` times as often as the word or more, else null. root: where
    the forms lead, the word itself where it has none. Counts rise along forms, so there is no circle.
    """
    words = materialise(words.select("word", "n"), "vocabulary")
    near = near_words(words)
    told = words.join(near, "word", "left")
    is_form = F.col("best_n") >= F.col("n") * ratio
    told = materialise(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near")
    roots = settle(told.filter("form is not null").select(F.col("word").alias("node"), F.col("form").alias("root")))
    return told.join(roots.withColumnRenamed("node", "word"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))
