"""Schemas of the catalog's tables, with the defaults that stand for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "images": "image_id long, path string, size long, ext string, mtime double, source string, width int, height int",
    "image_hashes": "image_id long, phash long, mtime double",
    "embeddings": "image_id long, vector array<float>, mtime double",
    "clusters": "image_id long, cluster_id int, name string",
    "dedup_groups": "group_id long, image_id long, is_canonical int",
    "failed_files": "path string, reason string",
    "selected_files": "path string, scope string",
    "thumbnails": "path string, mtime double, size long, ext string, blob binary",
    "hash_members": "image_id long, phash long, rep long",
    "hash_keys": "bucket long, phash long",
    "group_state": "name string, value long",
}
KEYS = {"images": ["path"], "image_hashes": ["image_id"], "embeddings": ["image_id"], "clusters": ["image_id"], "dedup_groups": ["group_id", "image_id"], "failed_files": ["path"], "selected_files": ["path"], "thumbnails": ["path"], "hash_members": ["image_id"], "hash_keys": ["bucket", "phash"], "group_state": ["name"]}
#: Tables whose rows go with their image.
CHILDREN = ("image_hashes", "embeddings", "clusters", "dedup_groups")
DEFAULTS = {"size": 0, "ext": "", "mtime": 0.0, "source": "", "width": 0, "height": 0, "name": "", "is_canonical": 0, "reason": "corrupt", "scope": "global"}


def conform(df: DataFrame, table: str, part: str | None = None) -> DataFrame:
    """df with the table's columns and types: missing ones added, defaults for nulls, others dropped but for `part`."""
    out = []
    for column in TABLES[table].split(", "):
        name, kind = column.split(" ")
        value = F.col(name) if name in df.columns else F.lit(None)
        default = "webp" if (table, name) == ("thumbnails", "ext") else DEFAULTS.get(name)
        out.append((F.coalesce(value.cast(kind), F.lit(default).cast(kind)) if default is not None else value.cast(kind)).alias(name))
    return df.select(*out, *([F.col(part).cast("long").alias(part)] if part else []))
