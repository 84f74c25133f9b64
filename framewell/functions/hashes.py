"""64-bit hashes as signed longs: bit patterns, never compared as numbers."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from _md5 import md5  # the same, at less than half the cost of a call
except ImportError:
    from hashlib import md5


def unsigned(h: Column) -> Column:
    """The unsigned value, for display."""
    return h.cast("decimal(20,0)") + F.when(h < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0))


def signed(value: Column) -> Column:
    """The stored long of an unsigned decimal."""
    half, whole = (F.lit(x).cast("decimal(20,0)") for x in ("9223372036854775808", "18446744073709551616"))
    return F.when(value >= half, (value - whole).cast("long")).otherwise(value.cast("long"))


def from_bits(bits: Column) -> Column:
    """An array of 64 numbers as a long, the first the highest bit; above zero is 1."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_layout(bands: int = 8) -> list[tuple[int, int]]:
    """(shift, mask) of each band from the top bit down; the first 64 % bands are one bit wider."""
    out, left = [], 64
    for k in range(bands):
        width = 64 // bands + (k < 64 % bands)
        left -= width
        out.append((left, (1 << width) - 1))
    return out


def band_values(h: Column, bands: int = 8) -> Column:
    return F.array(*[F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long")) for shift, mask in band_layout(bands)])


def _masks(bits: list[int], radius: int, bands: int) -> list[int]:
    """Signed masks of all combinations of bands - radius bands of the bits: hashes within the radius agree under one."""
    wide, left, parts = len(bits) // bands, len(bits) % bands, []
    for k in range(bands):
        at = k * wide + min(k, left)
        parts.append(sum(1 << b for b in bits[at : at + wide + (k < left)]))
    out = [sum(some) for some in combinations(parts, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def shared_band_keys(h: Column, radius: int = 6, bands: int = 8) -> Column:
    """Array of (combination, key): hashes within the radius agree in a key of at least one combination of bands.

    More bands make keys of more bits and so smaller buckets, for more keys a hash: 8 bands give 28 keys of 16 bits at
    radius 6, 10 bands 210 keys of 25.
    """
    if bands <= radius:
        raise ValueError("a radius needs more bands than bits")
    return F.array(*[F.struct(F.lit(k).alias("combination"), h.bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(_masks([*reversed(range(64))], radius, bands))])


def further_masks(radius: int = 6, bands: int = 8) -> list[list[int]]:
    """For each combination of `shared_band_keys` the masks that do the same for the bits it leaves."""
    whole = (1 << 64) - 1
    return [_masks([b for b in reversed(range(64)) if not (m & whole) >> b & 1], radius, min(radius + 2, 64)) for m in _masks([*reversed(range(64))], radius, bands)]


#: Digests a task keeps at most, and the longest tokens it keeps them of.
TOKENS, TOKEN = 1 << 17, 64


class _Digests(dict):
    """The first 8 bytes of the MD5 of each token asked for; those of the first short ones are kept."""

    def __missing__(self, token: bytes) -> bytes:
        digest = md5(token).digest()[:8]
        if len(self) < TOKENS and len(token) <= TOKEN:
            self[token] = digest
        return digest


def _bit_counts(bits: np.ndarray) -> np.ndarray:
    """Sums of rows of 64 bits: 255 rows at a time are added up as bytes."""
    whole = len(bits) // 255 * 255
    out = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out + bits[whole:].sum(axis=0, dtype=np.uint8)


def _simhashes(batches):
    """mapInArrow work over (id, text)."""
    digests, blank = _Digests(), bytes.maketrans(b"\n\r\t", b"   ")
    for b in batches:
        ids, out = [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            tokens = [t for t in (text.as_py() or b"").translate(blank).split(b" ") if t]
            if not tokens:
                continue
            counts = np.zeros(64, np.int64)
            for at in range(0, len(tokens), TOKENS):
                some = np.frombuffer(b"".join([digests[t] for t in tokens[at : at + TOKENS]]), np.uint8).reshape(-1, 8)
                counts += _bit_counts(np.unpackbits(some, axis=1))
            ids.append(key)
            out.append(int.from_bytes(np.packbits(counts * 2 > len(tokens)).tobytes(), "big", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(out, pa.int64())], names=["id", "phash"])


def token_simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, phash): bit b is set where over half of the text's tokens have it in the first 64 bits of their MD5.

    Stands for a picture's hash where there are texts only. Texts without tokens have no hash. A text's tokens are
    counted where it is read; only texts whose id is not their own alone meet by it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    twice = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if twice.isEmpty():
        return rows.mapInArrow(_simhashes, f"id {kind}, phash long")
    whole = rows.filter("text is not null").groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return whole.mapInArrow(_simhashes, f"id {kind}, phash long")
