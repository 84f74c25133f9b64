"""Names free of collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.functions.paths import basename, stem, suffix
from framewell.plans.numbering import ranks_within

_NUMBERED = r"(?s)^(.*)_([1-9][0-9]{0,17})$"


def unique_names(rows: DataFrame, taken: DataFrame | None = None, path: str = "path") -> DataFrame:
    """rows with unique_name: the file's name, or stem_1.ext, stem_2.ext ... for later ones by path.

    Numbers whose name another file bears already, or that `taken` (column name) holds, are passed over: a name's files
    take its free numbers in turn, 0 being the name itself. Two names never give the same numbered one, so what is not
    free is known beforehand, and any number of collisions is settled at once. A file's number is its place among its
    name's files and the used numbers that go before it, so ranks are all that is needed, and a name that a third of all
    files have is no task of its own.
    """

    def numbered(name, k):
        return F.concat(stem(name), F.lit("_"), k, suffix(name))

    name = basename(F.col(path))
    named = ranks_within(rows.withColumn("_name", name).withColumn("_key", F.coalesce(name, F.lit("\0"))), "_key", [path], "_at")
    own = rows.select(basename(F.col(path)).alias("_bears")).filter("_bears is not null").distinct()
    held = taken.select(F.col("name").alias("_bears")).filter("_bears is not null").distinct() if taken is not None else own.limit(0)
    of = F.concat(F.regexp_extract(stem(F.col("_bears")), _NUMBERED, 1), suffix(F.col("_bears")))
    number = F.regexp_extract(stem(F.col("_bears")), _NUMBERED, 2).try_cast("long")
    later = own.union(held).distinct().select("_bears", of.alias("_name"), number.alias("_number")).filter(numbered(F.col("_name"), F.col("_number")) == F.col("_bears"))
    used = later.select("_name", "_number").union(held.select("_bears", F.lit(0).cast("long")))
    # a used number is told by the free ones below it: as many files of the name come before it
    used = used.join(own.withColumnRenamed("_bears", "_name"), "_name", "left_semi").withColumn("_key", F.col("_name"))
    used = ranks_within(used, "_key", ["_number"], "_turn").select("_key", (F.col("_number") - F.col("_turn")).alias("_at"), F.lit(1).alias("_used"))
    both = ranks_within(named.withColumn("_used", F.lit(0)).unionByName(used, allowMissingColumns=True), "_key", ["_at", F.desc("_used")], "_k")
    out = both.filter("_used = 0").withColumn("unique_name", F.when(F.col("_k") == 0, F.col("_name")).otherwise(numbered(F.col("_name"), F.col("_k"))))
    return out.select(*rows.columns, "unique_name")
