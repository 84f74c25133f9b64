"""Numbers, orders and pages of what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.plans.numbering import row_numbers
from framewell.session import materialise


def cluster_numbers(clusters: DataFrame, columns: int = 3) -> DataFrame:
    """(cluster_id, number, grid_column, grid_row): clusters in order of id, numbered from 1 and laid out in rows.

    The window runs over the distinct ids, which are few.
    """
    ids = clusters.select("cluster_id").distinct()
    n = F.row_number().over(Window.orderBy("cluster_id"))
    numbered = ids.select("cluster_id", n.alias("number"))
    return numbered.select("cluster_id", "number", ((F.col("number") - 1) % columns).alias("grid_column"), F.floor((F.col("number") - 1) / columns).alias("grid_row"))


def cluster_names(clusters: DataFrame) -> DataFrame:
    """(cluster_id, name): the first name that is not empty, by spelling."""
    return clusters.groupBy("cluster_id").agg(F.coalesce(F.min(F.when(F.col("name") != "", F.col("name"))), F.lit("")).alias("name"))


def members(clusters: DataFrame, images: DataFrame) -> DataFrame:
    """(cluster_id, path); a list a cluster is only for showing, and made there."""
    return clusters.join(images, "image_id").select("cluster_id", "path")


def _numbered(clusters: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their number in the order of all by cluster and path; the first and last number of each cluster)."""
    rows = materialise(row_numbers(members(clusters, images), ["cluster_id", "path"]), "numbered")
    return rows, rows.groupBy("cluster_id").agg(F.min("number").alias("low"), F.max("number").alias("high"))


def member_places(clusters: DataFrame, images: DataFrame) -> DataFrame:
    """(cluster_id, place, path): members of each cluster in order of path, from 1."""
    rows, ends = _numbered(clusters, images)
    return rows.join(ends, "cluster_id").select("cluster_id", (F.col("number") - F.col("low") + 1).alias("place"), "path")


def top_clusters(clusters: DataFrame, images: DataFrame, n: int = 10, most: int = 10) -> DataFrame:
    """(cluster_id, n, paths) of the largest real clusters, with their first paths."""
    large = clusters.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(n)
    some = members(clusters.join(F.broadcast(large.select("cluster_id")), "cluster_id", "left_semi"), images)
    first = some.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("path"))).filter(F.col("_r") <= most)
    return large.join(first.groupBy("cluster_id").agg(F.array_sort(F.collect_list("path")).alias("paths")), "cluster_id")


def path_to_cluster(paths: DataFrame, clusters: DataFrame, images: DataFrame) -> DataFrame:
    """(path, cluster_id) of the asked paths, null where they have no cluster."""
    return paths.join(members(clusters, images), "path", "left").select("path", "cluster_id")


def mark_garbage(clusters: DataFrame, garbage: DataFrame) -> DataFrame:
    """clusters with the given images set to -2, named garbage; images without a row get one."""
    bad = garbage.select("image_id").distinct()
    new = bad.select("image_id", F.lit(-2).alias("cluster_id"), F.lit("garbage").alias("name"))
    return clusters.select("image_id", "cluster_id", "name").join(bad, "image_id", "left_anti").unionByName(new)


def page(rows: DataFrame, offset: int, size: int, order: str = "path") -> DataFrame:
    """One page by order; an offset beyond the rows (or below 0) begins anew."""
    if offset < 0 or (offset and rows.count() <= offset):
        offset = 0
    return rows.orderBy(order).offset(offset).limit(size)


def page_size(columns: int, rows: int, n: int) -> int:
    return min(n, max(10, columns * rows * 3))


def prewarm_order(clusters: DataFrame, images: DataFrame) -> DataFrame:
    """(path, cluster_id): every path once, with the first cluster in order of id; order by (cluster_id, path)."""
    rows = members(clusters, images)
    return rows.groupBy("path").agg(F.min("cluster_id").alias("cluster_id"))


def with_neighbours(clusters: DataFrame, images: DataFrame) -> DataFrame:
    """(cluster_id, path, previous_path, next_path) by path, around the ends of each cluster.

    A member's neighbours are looked up by its number in the order of all, so no task holds a cluster.
    """
    rows, ends = _numbered(clusters, images)
    told = rows.join(ends, "cluster_id")
    before = F.when(F.col("number") == F.col("low"), F.col("high")).otherwise(F.col("number") - 1)
    after = F.when(F.col("number") == F.col("high"), F.col("low")).otherwise(F.col("number") + 1)
    told = told.select("cluster_id", "path", before.alias("_before"), after.alias("_after"))
    one = rows.select(F.col("number").alias("_before"), F.col("path").alias("previous_path"))
    two = rows.select(F.col("number").alias("_after"), F.col("path").alias("next_path"))
    return told.join(one, "_before").join(two, "_after").select("cluster_id", "path", "previous_path", "next_path")


def cached(df: DataFrame) -> DataFrame:
    """A read-through result that later calls share, until unpersist()."""
    return df.cache()
