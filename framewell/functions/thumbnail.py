"""Thumbnails: a picture fitted into a square, the rest black."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.config import CONFIG
from framewell.functions.exif import turned


def _resampled(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over each target point's area; nearest rows and columns where the picture grows."""

    def weights(n: int, m: int) -> np.ndarray:
        if m >= n:
            return np.eye(n)[np.minimum((np.arange(m) * n) // m, n - 1)]
        edges = np.linspace(0, n, m + 1)
        low = np.arange(n)
        return np.clip(np.minimum(low + 1, edges[1:, None]) - np.maximum(low, edges[:-1, None]), 0, None) * m / n

    rows, columns = weights(image.shape[0], height), weights(image.shape[1], width)
    return np.einsum("ab,bcd,ec->aed", rows, image.astype(float), columns)


def squared(raster: np.ndarray, side: int = CONFIG.thumb_side) -> np.ndarray:
    """RGB of a BGR(A) or grey picture, no larger than the side, in the middle of a black square of its longer side."""
    rgb = raster[:, :, [2, 1, 0]] if raster.shape[2] >= 3 else np.repeat(raster[:, :, :1], 3, axis=2)
    h, w = rgb.shape[:2]
    scale = min(1.0, side / max(h, w))
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    small = np.clip(np.rint(_resampled(rgb, nh, nw)), 0, 255).astype(np.uint8)
    out = np.zeros((max(nh, nw), max(nh, nw), 3), np.uint8)
    y, x = (len(out) - nh) // 2, (len(out) - nw) // 2
    out[y : y + nh, x : x + nw] = small
    return out


def png(rgb: np.ndarray) -> bytes:
    """The picture as PNG; callers with an encoder of their own pass it to `thumbnails`."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = rgb.shape[:2]
    rows = np.concatenate((np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)), axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def thumbnails(decoded: DataFrame, side: int = CONFIG.thumb_side, encode=png, ext: str = "png") -> DataFrame:
    """(path, ext, blob) of decoded pictures, upright where they bring their orientation; those that can't be read have a null blob."""

    def run(batches):
        for b in batches:
            out = []
            for height, width, channels, data, how in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                try:
                    out.append(encode(squared(turned(np.frombuffer(data, np.uint8).reshape(height, width, channels), how), side)))
                except (TypeError, ValueError, IndexError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ext] * len(out), pa.string()), pa.array(out, pa.binary())], names=["path", "ext", "blob"])

    how = F.col("orientation") if "orientation" in decoded.columns else F.lit(1).alias("orientation")
    return decoded.select("path", "height", "width", "channels", "data", how).mapInArrow(run, "path string, ext string, blob binary")
