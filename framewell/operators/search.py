"""Exact vector search: cosine top-k and the range below the best score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.config import CONFIG
from framewell.functions.vectors import constant, dot, l2_normalised
from framewell.plans.numbering import row_numbers


def normalised_index(vectors: DataFrame) -> DataFrame:
    """Vectors at unit length, kept in memory across searches; unpersist() it after the vectors change."""
    return vectors.withColumn("vector", l2_normalised(F.col("vector"))).cache()


def centroid(vectors: DataFrame) -> list[float]:
    """The mean of the vectors at unit length; one number a dimension comes to the driver."""
    parts = vectors.select(F.posexplode("vector").alias("k", "x")).groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("k").collect()
    size = sum(r["x"] ** 2 for r in parts) ** 0.5 or 1.0
    return [r["x"] / size for r in parts]


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(image_id, score): cosine with the query."""
    size = sum(x * x for x in query) ** 0.5 or 1.0
    return vectors.select("image_id", dot(l2_normalised(F.col("vector")), constant(x / size for x in query)).alias("score"))


def ranked(scores: DataFrame, top: int | None) -> DataFrame:
    """Scores in order, ties by id, with their rank; no more than top where it is above 0."""
    order = [F.desc("score"), "image_id"]
    if top and top > 0:  # so few rows are ranked by one task
        return scores.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return row_numbers(scores, order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def cosine_top(vectors: DataFrame, query: list[float], top: int | None = CONFIG.search_top) -> DataFrame:
    return ranked(scored(vectors, query), top)


def semantic_search(vectors: DataFrame, query: list[float], top: int | None = None, slack: float = CONFIG.search_slack) -> DataFrame:
    """(image_id, score, rank) of all scores down to slack below the best; top-k alone where slack or the best is not above 0."""
    scores = scored(vectors, query)
    if slack <= 0:
        return ranked(scores, top)
    best = scores.agg(F.max("score")).first()[0]  # one number
    if best is None or best <= 0:
        return ranked(scores, top)
    return ranked(scores.filter(F.col("score") >= best - slack), top)


def with_clusters(results: DataFrame, clusters: DataFrame) -> DataFrame:
    """Search results with their cluster, null where there is none."""
    return results.join(clusters.select("image_id", "cluster_id"), "image_id", "left")
