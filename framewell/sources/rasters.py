"""Pictures as rows of their points, from the JVM's own decoders and from those that the caller brings for a format."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.functions.exif import orientation
from framewell.sources import files

SCHEMA = "path string, height int, width int, channels int, data binary"
#: Points of a picture that a caller's decoder may return at most: a larger one counts as one that can't be read.
MOST_POINTS = 1 << 28


def picture_format(content: Column) -> Column:
    """jpeg, png, gif, bmp, tiff or webp by a file's first bytes; null for others."""

    def begins(bytes_: bytes, at: int = 1) -> Column:
        return F.substring(content, at, len(bytes_)) == F.lit(bytes_)

    out = F.when(begins(b"\xff\xd8\xff"), "jpeg").when(begins(b"\x89PNG\r\n\x1a\n"), "png").when(begins(b"GIF8"), "gif").when(begins(b"BM"), "bmp")
    return out.when(begins(b"II*\0") | begins(b"MM\0*"), "tiff").when(begins(b"RIFF") & begins(b"WEBP", 9), "webp")


def points(raster) -> np.ndarray:
    """What a decoder returned as (height, width, channels) of bytes; ValueError if it is no picture."""
    raster = np.asarray(raster)
    if raster.ndim == 2:
        raster = raster[:, :, None]
    if raster.ndim != 3 or raster.dtype != np.uint8 or not 0 < raster.size <= MOST_POINTS * raster.shape[2]:
        raise ValueError("a decoder returns (height, width, channels) of bytes")
    return np.ascontiguousarray(raster)


def decoded_by(contents: DataFrame, decoders: dict[str, Callable[[bytes], np.ndarray]]) -> DataFrame:
    """(path, height, width, channels, data, orientation) of contents (path, ext, content) by the decoder of each extension.

    A decoder gets a file's bytes and returns rows of points, blue first as the picture source has them. A picture
    that its decoder fails on, of whatever kind, has no row. Each task holds one picture at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "height", "width", "channels", "data", "orientation"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
        for b in batches:
            for path, ext, content in zip(*b.columns, strict=True):
                data = content.as_py()
                try:
                    raster = points(decoders[ext.as_py()](data))
                except Exception:  # what a caller's decoder raises is not known
                    continue
                row = (path.as_py(), *raster.shape, raster.tobytes(), orientation(data))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    asked = contents.filter(F.col("content").isNotNull()).select("path", F.lower("ext").alias("ext"), "content")
    return asked.filter(F.col("ext").isin(*decoders)).mapInArrow(run, f"{SCHEMA}, orientation int")


def rasters(spark: SparkSession, wanted: DataFrame, decoders: dict[str, Callable] | None = None, turns: bool = False) -> DataFrame:
    """(path, height, width, channels, data, orientation) of wanted (path, source), a written table, and its ext where
    there are decoders.

    decoders: by extension, in lower case; the JVM reads all others. Pictures that can't be read have no row. turns: tell
    the orientation of what the JVM reads; else it is null there.
    """
    decoders = decoders or {}
    own = F.coalesce(F.lower("ext").isin(*decoders), F.lit(False)) if decoders else F.lit(False)
    left, out = wanted.filter(~own), spark.createDataFrame([], SCHEMA)
    for root in [r["source"] for r in left.select("source").distinct().collect()]:  # one a scanned root
        some = files.decoded(spark, root, left.filter(F.col("source").eqNullSafe(root)))
        out = out.unionByName(some.drop("mode"))
    if turns:
        told = files.orientations(files.pictures(spark, left.select("path", "source")).filter("content is not null"))
        out = out.join(told, "path", "left")
    else:
        out = out.withColumn("orientation", F.lit(None).cast("int"))
    if decoders:
        out = out.unionByName(decoded_by(files.pictures(spark, wanted.filter(own).select("path", "source", "ext")), decoders))
    return out
