"""The cache of thumbnails, keyed by path, time and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["path", "mtime", "size"]


def missing(images: DataFrame, thumbs: DataFrame, limit: int | None = None) -> DataFrame:
    """(image_id, path, mtime, size) of images without a thumbnail of this time and size; by id where limited."""
    left = images.select("image_id", *KEY).join(thumbs.select(*KEY), KEY, "left_anti").select("image_id", *KEY)
    return left.orderBy("image_id").limit(limit) if limit is not None else left


def count_missing(images: DataFrame, thumbs: DataFrame) -> DataFrame:
    return missing(images, thumbs).agg(F.count("*").alias("n"))


def fresh(asked: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Thumbnails that can be shown for the asked (path, mtime, size)."""
    return thumbs.join(asked.select(*KEY).distinct(), KEY, "left_semi")


def get_or_create(asked: DataFrame, thumbs: DataFrame, make) -> tuple[DataFrame, DataFrame]:
    """(all thumbnails asked for, those made now). make(df of path, mtime, size) returns it with a blob and its kind, ext
    (webp where it names none); null blobs failed."""
    there = fresh(asked, thumbs).select(*KEY, "ext", "blob")
    new = make(asked.select(*KEY).distinct().join(thumbs.select(*KEY), KEY, "left_anti"))
    ext = F.col("ext") if "ext" in new.columns else F.lit("webp").alias("ext")
    new = new.filter("blob is not null").select(*KEY, ext, "blob")
    return there.unionByName(new), new


def meta_cached(stats: DataFrame, now: float, ttl: float) -> DataFrame:
    """Rows of a stat cache that are still valid."""
    return stats.filter(F.lit(now) - F.col("fetched_at") < ttl)
