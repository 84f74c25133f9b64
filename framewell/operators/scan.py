"""File selection, the snapshot diff and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.config import CONFIG
from framewell.functions.paths import allowed_extension, basename, extension, in_excluded_dir


def select_files(files: DataFrame, extensions: list[str] | None = None, exclude_dirs: list[str] | None = None, min_size: int = CONFIG.min_size, relative: Column | None = None) -> DataFrame:
    """Rows of (path, size, mtime, ...) that a scan keeps; a size or time that could not be read counts as 0.

    relative: the path below the scanned root, for the excluded directories; without it the whole path is asked.
    """
    name = basename(F.col("path"))
    rows = files.withColumn("ext", extension(name)).withColumn("size", F.coalesce("size", F.lit(0))).withColumn("mtime", F.coalesce("mtime", F.lit(0.0)))
    inside = in_excluded_dir(F.ltrim(F.lit("/"), F.col("path")) if relative is None else relative, exclude_dirs)
    return rows.filter(allowed_extension(F.col("ext"), extensions) & (F.col("size") >= min_size) & ~inside)


def changed(new: str = "n", old: str = "o") -> Column:
    """Size or time differ; times to the millisecond, which is what file listings keep."""
    ms = lambda side: F.round(F.col(f"{side}.mtime") * 1000).cast("long")
    return (F.col(f"{new}.size") != F.col(f"{old}.size")) | (ms(new) != ms(old))


def snapshot_diff(new: DataFrame, old: DataFrame, source: str | None = None) -> DataFrame:
    """(path, status): new, changed, removed or unchanged. With a source, rows of other sources are never removed."""
    gone = F.lit(True) if source is None else F.col("o.source") == source
    status = (
        F.when(F.col("o.path").isNull(), "new")
        .when(F.col("n.path").isNull(), F.when(gone, "removed"))
        .when(changed(), "changed")
        .otherwise("unchanged")
    )
    both = new.alias("n").join(old.alias("o"), F.col("n.path") == F.col("o.path"), "full_outer")
    return both.select(F.coalesce("n.path", "o.path").alias("path"), status.alias("status")).filter("status is not null")


def merge_snapshot(new: DataFrame, old: DataFrame, source: str | None = None) -> DataFrame:
    """The catalog's images after a scan: removed rows go, changed ones take size, ext, mtime and source but keep id and
    dimensions, new ones come in. One full outer join does it all."""
    gone = F.lit(True) if source is None else F.col("o.source") == source
    both = new.alias("n").join(old.alias("o"), F.col("n.path") == F.col("o.path"), "full_outer").filter(F.col("n.path").isNotNull() | ~gone)
    fresh = F.col("o.path").isNull() | (F.col("n.path").isNotNull() & changed())
    take = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    return both.select(keep("image_id"), keep("path"), take("size"), take("ext"), take("mtime"), take("source"), keep("width"), keep("height"))


def surviving(child: DataFrame, images: DataFrame) -> DataFrame:
    """A child table without rows of removed images."""
    return child.join(images.select("image_id"), "image_id", "left_semi")


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; insert-or-ignore keeps these."""
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_turn = 1").drop("_turn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old with those of new in place of equal keys; new's keys are unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def stale(candidates: DataFrame, saved: DataFrame, duplicates: DataFrame, failed: DataFrame) -> DataFrame:
    """Images to compute anew: neither duplicates nor failed, and without a saved row of the same time.

    candidates: image_id, path, mtime; saved: image_id, mtime; duplicates, failed: path.
    """
    out = duplicates.select("path").union(failed.select("path")).distinct()
    left = candidates.join(out, "path", "left_anti").join(saved.select("image_id", F.col("mtime").alias("_saved")), "image_id", "left")
    return left.filter(F.col("_saved").isNull() | (F.col("_saved") != F.coalesce("mtime", F.lit(0.0)))).drop("_saved")


def without_nested_roots(roots: DataFrame, path: str = "root") -> DataFrame:
    """Roots that are not inside another one; of equal ones the first by order of spelling.

    Every root is asked for its ancestors, which a path lists itself, so this is an equality join, not one on prefixes.
    """
    norm = F.when(F.col(path) == "/", F.lit("/")).otherwise(F.regexp_replace(F.regexp_replace(F.col(path), "/+", "/"), "/$", ""))
    named = roots.select(F.col(path).alias("root"), norm.alias("_n")).filter("_n <> ''")
    first = first_per(named, ["_n"], ["root"])
    parts = F.split("_n", "/")
    count = F.when(F.col("_n") == "/", F.lit(0)).otherwise(F.size(parts) - 1)
    ups = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.when((k == 0) & F.col("_n").startswith("/"), "/").otherwise(F.array_join(F.slice(parts, 1, k + 1), "/")))
    asked = first.select("_n", F.explode(F.filter(F.array_distinct(ups), lambda u: (u != F.col("_n")) & (u != ""))).alias("_up"))
    nested = asked.join(first.select(F.col("_n").alias("_up")), "_up", "left_semi").select("_n").distinct()
    return first.join(nested, "_n", "left_anti").select("root")


def report_by_extension(images: DataFrame) -> DataFrame:
    """(ext, n, bytes), most files first, ties by name."""
    return images.groupBy("ext").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).orderBy(F.desc("n"), "ext")


def scan_totals(images: DataFrame) -> DataFrame:
    return images.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def count_by_root(images: DataFrame) -> DataFrame:
    """(source, n) of each root, and the total with source null."""
    return images.rollup("source").agg(F.count("*").alias("n"))
