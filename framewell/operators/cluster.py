"""Density clustering: core distances, a spanning tree, its whole hierarchy, and the refinements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.config import CONFIG, min_cluster_size, sub_min_cluster_size
from framewell.functions.vectors import l2_normalised
from framewell.operators import spanning
from framewell.operators.hierarchy import hierarchy_labels
from framewell.operators.layout import learned_layout
from framewell.operators.neighbours import knn_join, knn_rescue, noise_rescue
from framewell.operators.spanning import reachable as mutual_reachability  # noqa: F401
from framewell.operators.spanning import spanning_tree
from framewell.session import materialise


def core_distances(vectors: DataFrame, k: int) -> DataFrame:
    """(image_id, core): distance to the k-th nearest row, the row itself counted as the first."""
    return spanning.core_distances(knn_join(vectors, vectors, k), k)


def density_labels(vectors: DataFrame, size: int, samples: int | None = None, leaf: bool = False) -> DataFrame:
    """(image_id, cluster_id): -1 for noise, clusters from 1 by their smallest member.

    size: members that make a cluster. Clusters are chosen from the whole hierarchy by excess of mass; with `leaf` the
    ones that don't split are chosen. The whole set is never one cluster.
    """
    rows = materialise(vectors.select("image_id", "vector"), "vectors")
    k = samples or max(2, size // 5)
    near = materialise(knn_join(rows, rows, max(k, spanning.NEAR)), "near")
    tree = spanning_tree(rows, materialise(spanning.core_distances(near, k), "cores"), near)
    return hierarchy_labels(materialise(tree, "tree"), rows, size, leaf)


def reduced(vectors: DataFrame, components: int = CONFIG.reduce_to) -> DataFrame:
    """Vectors on their first principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("image_id", array_to_vector(l2_normalised(F.col("vector"))).alias("features"))
    model = PCA(k=components, inputCol="features", outputCol="low").fit(rows)
    return model.transform(rows).select("image_id", vector_to_array("low").alias("vector"))


def kmeans_labels(vectors: DataFrame, clusters: int = CONFIG.kmeans_clusters, seed: int = CONFIG.seed) -> DataFrame:
    """(image_id, cluster_id) from 0 by k-means over unit vectors; for sets too small for densities. Under 2 rows: all 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.limit(max(2, clusters)).count()
    if n < 2:
        return vectors.select("image_id", F.lit(0).alias("cluster_id"))
    rows = vectors.select("image_id", array_to_vector(l2_normalised(F.col("vector"))).alias("features"))
    model = KMeans(k=min(n, clusters), seed=seed, featuresCol="features", predictionCol="cluster_id").fit(rows)
    return model.transform(rows).select("image_id", "cluster_id")


def refine_mega(vectors: DataFrame, low: DataFrame, labels: DataFrame, share: float = CONFIG.mega_share, explode=None) -> DataFrame:
    """labels with each oversized cluster taken apart: what its own clustering calls noise becomes garbage (-2), the rest
    is given the label most of its nearest rows of other clusters have; with none to ask, it keeps its label.

    All votes are over the labels as they came in, so the order of the clusters does not matter. `explode` labels a
    cluster's vectors; one small row a cluster comes to the driver to begin with.
    """
    from framewell.operators.stats import mega_clusters

    done = labels.select("image_id", "cluster_id")
    for row in mega_clusters(labels, share).collect():
        mega, n = row["cluster_id"], row["n"]
        mine = vectors.join(labels.filter(F.col("cluster_id") == mega).select("image_id"), "image_id", "left_semi")
        sub = explode(mine) if explode else density_labels(reduced(mine, CONFIG.sub_reduce_to), sub_min_cluster_size(n), CONFIG.sub_min_samples, leaf=True)
        sub = materialise(sub, "sub")
        saved = knn_rescue(low, labels, sub.filter("cluster_id >= 0"), mega)
        told = sub.join(saved.withColumnRenamed("cluster_id", "_voted"), "image_id", "left").select("image_id", F.when(F.col("cluster_id") == -1, -2).otherwise(F.coalesce("_voted", F.lit(mega))).alias("_new"))
        done = materialise(done.join(told, "image_id", "left").select("image_id", F.coalesce("_new", "cluster_id").alias("cluster_id")), "refined")
    return done


def cluster(vectors: DataFrame, layout: bool = True) -> DataFrame:
    """(image_id, cluster_id): the whole procedure from vectors to labels.

    layout: densities are those of the learned layout, else of the principal components, which need no neighbours of the
    vectors themselves.
    """
    n = vectors.count()
    if n < 20:
        return kmeans_labels(vectors, max(1, min(n, CONFIG.kmeans_clusters)))
    low = materialise(learned_layout(vectors) if layout else reduced(vectors), "low")
    labels = materialise(density_labels(low, min_cluster_size(n)), "labels")
    labels = materialise(refine_mega(vectors, low, labels), "labels")
    return noise_rescue(low, labels)
