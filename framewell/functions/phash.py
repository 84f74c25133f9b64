"""The perceptual hash of a picture: signs of its low DCT frequencies."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE, LOW = 32, 8


def _dct(n: int) -> np.ndarray:
    """The DCT-II as a matrix."""
    k = np.arange(n)
    return 2 * np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def grey(raster: np.ndarray) -> np.ndarray:
    """Luma of BGR(A) rows, as stored by the picture source, in whole numbers; one channel stays."""
    if raster.shape[2] < 3:
        return raster[:, :, 0].astype(np.int64)
    # shares of blue, green and red in 65,536ths
    return (raster[:, :, :3].astype(np.int64) @ [7471, 38470, 19595] + 32768) >> 16


@lru_cache(maxsize=64)
def sinc_weights(n: int, side: int = SIDE) -> np.ndarray:
    """What each of n points adds to each of `side` points: a windowed sinc of three lobes, as wide as the shrink asks.

    In whole numbers of 1 / 2^22. Enlarging, the filter has its own width.
    """
    step = n / side
    wide = max(step, 1.0)
    centre = (np.arange(side) + 0.5) * step
    # whole points within three lobes of the centre
    first, end = np.maximum(0, np.trunc(centre - 3 * wide + 0.5)), np.minimum(n, np.trunc(centre + 3 * wide + 0.5))
    at = np.arange(n)
    x = (at[None, :] - centre[:, None] + 0.5) / wide
    weight = np.where((at >= first[:, None]) & (at < end[:, None]) & (np.abs(x) < 3), np.sinc(x) * np.sinc(x / 3), 0.0)
    return np.rint(weight / weight.sum(axis=1, keepdims=True) * (1 << 22)).astype(np.int64)


def _rounded(sums: np.ndarray) -> np.ndarray:
    return np.clip((sums + (1 << 21)) >> 22, 0, 255)


def shrunk(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The picture at side x side (it is stretched to a square), along its rows first, to whole grey levels each time."""
    height, width = image.shape
    return _rounded(sinc_weights(height, side) @ _rounded(image @ sinc_weights(width, side).T))


def phash(raster: np.ndarray) -> int:
    """Signed 64-bit hash: bit set where a coefficient is over the median of the 64 lowest, the first the highest bit."""
    d = _dct(SIDE)
    low = (d @ shrunk(grey(raster)) @ d.T)[:LOW, :LOW]
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def hashed(decoded: DataFrame) -> DataFrame:
    """(path, phash, width, height, reason) of decoded pictures; a picture that can't be read has a null hash and `corrupt`."""

    def run(batches):
        names = ["path", "phash", "width", "height", "reason"]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for path, height, width, channels, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    row = (path, phash(np.frombuffer(data, np.uint8).reshape(height, width, channels)), width, height, None)
                except (TypeError, ValueError, IndexError):
                    row = (path, None, width, height, "corrupt")
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=names)

    return decoded.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, phash long, width int, height int, reason string")


def with_reasons(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """files with phash, width, height and the reason of a failure: not_found without any content; without a hash,
    unsupported if the bytes are of a format that the JVM has no decoder for, else corrupt."""
    from pyspark.sql import functions as F

    from framewell.sources.rasters import picture_format

    told = hashes.select("path", "phash", "width", "height", F.lit(True).alias("_read"))
    rows = files.join(told, "path", "left")
    missing = F.col("content").isNull() if "content" in files.columns else F.lit(False)
    foreign = picture_format(F.col("content")) == "webp" if "content" in files.columns else F.lit(False)
    reason = F.when(missing, "not_found").when(F.col("phash").isNull() & foreign & F.col("_read").isNull(), "unsupported").when(F.col("phash").isNull(), "corrupt")
    return rows.withColumn("reason", reason).drop("_read")
