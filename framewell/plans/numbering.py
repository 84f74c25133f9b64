"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.plans.joins import skew_join
from framewell.session import materialise


def row_numbers(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """df with the place of each row by order, from 0. Rows are dealt by ranges; only the ranges' sizes meet in one task."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = materialise(dealt.withColumn("_part", F.shiftright("_m", 33)), "ranges")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_m") - F.shiftleft(F.col("_part"), 33) + F.col("_off")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_m", "_part", "_off")


def ranks_within(df: DataFrame, key: str, order: list, name: str = "rank") -> DataFrame:
    """df with the place of each row among those of its key, from 0; key is never null.

    Rows are dealt by ranges of key and order together, so a key with very many rows lies in several tasks; where its
    rows begin is joined to them.
    """
    numbered = row_numbers(df, [key, *order], "_place")
    firsts = numbered.groupBy(key).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    return skew_join(numbered, firsts, key, "_rows").withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")
