"""The user's selection as a set of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_scope(old: DataFrame, paths: DataFrame, scope: str = "global") -> DataFrame:
    """The selection after a scope's paths are replaced; a path is in one scope only, the last that took it."""
    new = paths.select("path", F.lit(scope).alias("scope")).distinct()
    return old.filter(F.col("scope") != scope).join(new, "path", "left_anti").unionByName(new)


def toggle(selected: DataFrame, paths: DataFrame) -> DataFrame:
    """Each path leaves the selection if it is in, and joins it otherwise: the symmetric difference."""
    a, b = selected.select("path").distinct(), paths.select("path").distinct()
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(1)))
    return both.groupBy("path").agg(F.sum("_n").alias("_n")).filter("_n = 1").select("path")


def select_all(selected: DataFrame, paths: DataFrame, value: bool = True) -> DataFrame:
    mine = selected.select("path")
    return mine.union(paths.select("path")).distinct() if value else mine.distinct().join(paths.select("path"), "path", "left_anti")


def toggle_all(selected: DataFrame, paths: DataFrame) -> DataFrame:
    """All paths leave if all are in (no path at all counts as that), else all join. One pass, no round to the driver."""
    s = selected.select("path").distinct().withColumn("_s", F.lit(True))
    p = paths.select("path").distinct().withColumn("_p", F.lit(True))
    both = s.join(p, "path", "full_outer")
    whole = both.filter("_p").agg(F.coalesce(F.min(F.coalesce("_s", F.lit(False)).cast("int")), F.lit(1)).alias("_whole"))
    keep = F.when(F.col("_whole") == 1, F.col("_p").isNull()).otherwise(F.lit(True))
    return both.join(F.broadcast(whole), F.lit(True)).filter(keep).select("path")


def count_in_view(selected: DataFrame, view: DataFrame) -> DataFrame:
    return view.join(selected.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("n"))


def tri_state(n: Column, chosen: Column) -> Column:
    return F.when((n == 0) | (chosen == 0), "none").when(chosen == n, "all").otherwise("partial")


def state_by_group(members: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """(key, n, chosen, has_selection, state) of groups of paths."""
    mark = selected.select("path", F.lit(1).alias("_s")).distinct()
    counted = members.join(mark, "path", "left").groupBy(key).agg(F.count("*").alias("n"), F.count("_s").alias("chosen"))
    return counted.select(key, "n", "chosen", (F.col("chosen") > 0).alias("has_selection"), tri_state(F.col("n"), F.col("chosen")).alias("state"))
