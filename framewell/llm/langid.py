"""Language ID by prediction by partial matching over bytes.

Each language has a context tree of order 3: counts of the byte that followed each context of 3, 2, 1 and 0 bytes.
A byte seen in a context costs its share there; any other byte costs the context's escape (method C: distinct
followers over total plus distinct) and then what it costs in the next shorter context, down to a uniform byte.
The statistics are frozen after training, so the cost of every (context, byte) is a constant. All 256 byte values are
symbols; the costs are compiled into hash tables of the grams that training saw in any language, and what is in none
goes on to the shorter context there. A text's code length is the exact sum over all its bytes.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import as_bytes, map_arrow, text_batches

ORDER = 3
#: Training texts a language at most (in expectation; drawn by the text's hash from distinct texts).
TRAIN_TEXTS = 2000
#: What a text without a letter is given.
UNDETERMINED = "und"
#: The posterior counts a text as this many bytes at most, so that long texts don't all score 1.
SCORE_BYTES = 48
_WORD = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_COMPILED: dict[str, tuple] = {}


def has_letter(text: str) -> bool:
    """Whether it holds a letter of any script; numbers such as powers, fractions and numerals are none."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is held out as well."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _grams(data: bytes) -> np.ndarray:
    """Folded bytes with the start's spaces before them."""
    return np.concatenate((np.full(ORDER, 32, np.uint8), _FOLD[np.frombuffer(data, np.uint8)]))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_texts: int = TRAIN_TEXTS) -> dict:
    """Frozen statistics from the rows of docs: languages, and for each the counts of its 4-grams of bytes.

    docs holds training rows only. A bounded sample of them is read: a text is drawn if its hash falls under
    max_texts over the language's rows, and repeated texts count once. Null texts and languages are left out.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"id": uuid.uuid4().hex, "langs": [], "grams": []}
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, max_texts / max(1, sizes[k]))))])
    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    drawn = drawn.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).select("lang", "text")

    def count(batch):
        for lang in set(names := batch.column(0).to_pylist()):
            parts = [x for n, x in zip(names, as_bytes(batch.column(1)), strict=True) if n == lang]
            grams = [np.lib.stride_tricks.sliding_window_view(_grams(x), ORDER + 1) for x in parts if x]
            if grams:
                code, n = np.unique(np.concatenate(grams).astype(np.int64) @ (256 ** np.arange(ORDER, -1, -1)), return_counts=True)
                yield {"lang": [lang] * len(code), "gram": code, "n": n}

    counts = map_arrow(drawn, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (counts.column(k).to_numpy() for k in range(3))
    return {"id": uuid.uuid4().hex, "langs": langs, "grams": [(gram[lang == k].astype(np.uint32), n[lang == k]) for k in langs]}


class Codes:
    """An open-addressing hash table from distinct codes under 2 ** 32 to their places."""

    def __init__(self, codes: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(codes)).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(codes), dtype=np.int32)
        at = self._home(codes.astype(np.uint32))
        while len(todo):
            free = self.rows[at] < 0
            self.rows[at[free]] = todo[free]
            placed = self.rows[at] == todo
            todo, at = todo[~placed], (at[~placed] + 1) & (len(self.rows) - 1)
        held = self.rows >= 0
        self.keys[held] = codes[self.rows[held]]

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for one that is not in the table."""
        at = self._home(codes)
        out = self.rows[at]
        todo = np.flatnonzero((self.keys[at] != codes) & (out >= 0))
        at, codes = at[todo], codes[todo]
        while len(todo):
            at = (at + 1) & (len(self.rows) - 1)
            out[todo] = rows = self.rows[at]
            on = (self.keys[at] != codes) & (rows >= 0)
            todo, at, codes = todo[on], at[on], codes[on]
        return out


def compile_model(model: dict) -> tuple[tuple, tuple, tuple]:
    """Costs in bits, a column a language: (4-grams, their cost), (3-grams, their cost, their escape as a context) and
    (cost of each 2-gram, its escape as a context). A gram is a context and the byte after it."""
    if model["id"] in _COMPILED:
        return _COMPILED[model["id"]]
    n_langs, none = len(model["langs"]), np.empty(0, np.uint32)
    fours = np.unique(np.concatenate([none, *(gram for gram, _ in model["grams"])]))
    threes = np.unique(np.concatenate((fours >> 8, fours & 0xFFFFFF)))
    cost4, cost3, escape3 = np.empty((len(fours), n_langs), np.float32), np.empty((len(threes), n_langs), np.float32), np.empty((len(threes), n_langs), np.float32)
    cost2, escape2 = np.empty((1 << 16, n_langs), np.float32), np.empty((1 << 16, n_langs), np.float32)
    context4, rest4 = np.searchsorted(threes, fours >> 8), np.searchsorted(threes, fours & 0xFFFFFF)

    def shares(c, context, contexts):
        """(share of each gram with the count c in its context, 0 for a count of 0; each context's escape)."""
        total, kinds = np.bincount(context, c, contexts), np.bincount(context, c > 0, contexts)
        both = np.maximum(total + kinds, 1)
        return c / both[context], np.where(total > 0, kinds / both, 1.0)

    for k, (gram, n) in enumerate(model["grams"]):
        two = np.arange(1 << 16)
        p, escape = shares(np.bincount(gram & 255, n, 256), np.zeros(256, np.int64), 1)
        p = np.where(p > 0, p, escape[0] / 256)
        own, escape = shares(np.bincount(gram & 0xFFFF, n, 1 << 16), two >> 8, 256)
        p = np.where(own > 0, own, escape[two >> 8] * p[two & 255])
        own, escape = shares(np.bincount(np.searchsorted(threes, gram & 0xFFFFFF), n, len(threes)), threes >> 8, 1 << 16)
        cost2[:, k], escape2[:, k] = -np.log2(p), -np.log2(escape)
        p = np.where(own > 0, own, escape[threes >> 8] * p[threes & 0xFFFF])
        own, escape = shares(np.bincount(np.searchsorted(fours, gram), n, len(fours)), context4, len(threes))
        cost3[:, k], escape3[:, k] = -np.log2(p), -np.log2(escape)
        cost4[:, k] = -np.log2(np.where(own > 0, own, escape[context4] * p[rest4]))
    _COMPILED.clear()
    _COMPILED[model["id"]] = out = (Codes(fours), cost4), (Codes(threes), cost3, escape3), (cost2, escape2)
    return out


def code_lengths(data: bytes, fours: tuple, threes: tuple, twos: tuple, block: int = 1 << 20) -> np.ndarray:
    """Bits of the whole text under each language."""
    (grams, cost4), (contexts, cost3, escape3), (cost2, escape2) = fours, threes, twos
    s, bits = _grams(data), np.zeros(cost4.shape[1])
    for at in range(0, len(data), block):
        x = s[at : at + block + ORDER].astype(np.uint32)
        code = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
        row = grams.find(code)
        bits += cost4[row[row >= 0]].sum(axis=0, dtype=np.float64)
        code = code[row < 0]
        if len(code):
            row = contexts.find(code >> 8)
            bits += escape3[row[row >= 0]].sum(axis=0, dtype=np.float64)
            row = contexts.find(code & 0xFFFFFF)
            bits += cost3[row[row >= 0]].sum(axis=0, dtype=np.float64)
            code = code[row < 0]
            bits += escape2[code >> 8 & 0xFFFF].sum(axis=0, dtype=np.float64) + cost2[code & 0xFFFF].sum(axis=0, dtype=np.float64)
    return bits


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred, score (posterior under even priors), bits_per_byte of the best language.

    A null text, a text without a letter, or a model without languages gives `und`, score 0, bits null. Ties go to the first
    language in order. Null ids and repeated rows keep their rows. The model is bounded by the training sample, so it is broadcast.
    """
    text_batches(docs.sparkSession)
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    langs = model["langs"]

    def work(batch):
        pred, score, rate = [], [], []
        for text in batch.column(1).to_pylist():
            if not text or not langs or not has_letter(text):
                pred.append(UNDETERMINED), score.append(0.0), rate.append(None)
                continue
            data = text.encode()
            bits = code_lengths(data, *compile_model(frozen.value))
            best = int(bits.argmin())
            scaled = (bits - bits[best]) * (min(len(data), SCORE_BYTES) / len(data))
            pred.append(langs[best]), score.append(float(1 / np.exp2(-scaled).sum())), rate.append(float(bits[best] / len(data)))
        yield {"id": batch.column(0), "lang_pred": pred, "score": score, "bits_per_byte": pa.array(rate, pa.float64())}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, "id long, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: dict, reject_bits: float, text_col: str = "text") -> DataFrame:
    """The rows of docs with a letter in their text whose best language takes under reject_bits bits a byte; a model
    without languages keeps every text with a letter. Null texts go; other columns may be null."""
    text_batches(docs.sparkSession)
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    place, langs = docs.columns.index(text_col), model["langs"]

    def run(batches):
        for b in batches:
            keep = []
            for text in b.column(place).to_pylist():
                ok = bool(text) and has_letter(text)
                if ok and langs:
                    data = text.encode()
                    ok = bool(code_lengths(data, *compile_model(frozen.value)).min() < reject_bits * len(data))
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()))
    return predict(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "bits_per_byte")
