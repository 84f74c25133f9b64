"""One-row figures of the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(*rows: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), rows)


def db_stats(images: DataFrame, groups: DataFrame, clusters: DataFrame, pending: bool = False) -> DataFrame:
    """total, duplicates, unique_files, clusters (ids above 0), garbage, total_size; while dedup is pending, duplicates and
    unique_files are 0."""
    i = images.agg(F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    g = groups.agg(F.coalesce(F.sum(F.when(F.col("is_canonical") == 0, 1)), F.lit(0)).alias("duplicates"))
    c = clusters.agg(F.countDistinct(F.when(F.col("cluster_id") > 0, F.col("cluster_id"))).alias("clusters"), F.count(F.when(F.col("cluster_id") == -2, 1)).alias("garbage"))
    shown = lambda x: (F.lit(0).cast("long") if pending else x)
    return beside(i, g, c).select("total", shown(F.col("duplicates")).alias("duplicates"), shown(F.col("total") - F.col("duplicates")).alias("unique_files"), "clusters", "garbage", "total_size")


def selected_stats(selected: DataFrame, images: DataFrame, scope: str = "global") -> DataFrame:
    chosen = selected.filter(F.col("scope") == scope).join(images, "path")
    return chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def label_histogram(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))


def cluster_report(clusters: DataFrame) -> DataFrame:
    """n, clusters (neither noise nor garbage), noise_pct, garbage_pct (one decimal), mean_size (over clusters, one decimal)."""
    real = F.col("cluster_id") >= 0
    a = clusters.agg(
        F.count("*").alias("n"),
        F.countDistinct(F.when(real, F.col("cluster_id"))).alias("clusters"),
        F.count(F.when(F.col("cluster_id") == -1, 1)).alias("_noise"),
        F.count(F.when(F.col("cluster_id") == -2, 1)).alias("_garbage"),
        F.count(F.when(real, 1)).alias("_in"),
    )
    share = lambda x: F.when(F.col("n") > 0, F.round(F.col(x) * 100.0 / F.col("n"), 1)).otherwise(F.lit(0.0))
    mean = F.when(F.col("clusters") > 0, F.round(F.col("_in") / F.col("clusters"), 1)).otherwise(F.lit(0.0))
    return a.select("n", "clusters", share("_noise").alias("noise_pct"), share("_garbage").alias("garbage_pct"), mean.alias("mean_size"))


def mega_clusters(clusters: DataFrame, share: float) -> DataFrame:
    """(cluster_id, n) of clusters above 0 with more than the share of all rows, largest first."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("_total"))
    return sizes.join(F.broadcast(total), F.lit(True)).filter((F.col("cluster_id") > 0) & (F.col("n") / F.col("_total") > share)).select("cluster_id", "n").orderBy(F.desc("n"), "cluster_id")


def noise_share(clusters: DataFrame) -> DataFrame:
    return clusters.agg((F.count(F.when(F.col("cluster_id") == -1, 1)) / F.greatest(F.count("*"), F.lit(1))).alias("noise_share"))
