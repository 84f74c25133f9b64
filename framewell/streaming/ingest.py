"""New files as a stream: each micro-batch is taken into the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.config import CONFIG
from framewell.operators.catalog import Catalog
from framewell.operators.scan import first_per, select_files, upsert
from framewell.schema import conform
from framewell.sources.files import LISTING, _glob, _path


def arrivals(spark: SparkSession, root: str, extensions: list[str] | None = None, exclude_dirs: list[str] | None = None, min_size: int = CONFIG.min_size) -> DataFrame:
    """A stream of (path, size, mtime, ext, source) of files as they come in under the root."""
    reader = spark.readStream.format("binaryFile").schema(LISTING).option("recursiveFileLookup", True).option("pathGlobFilter", _glob(extensions))
    rows = reader.load(root).select(_path().alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.lit(root.rstrip("/")).alias("source"))
    return select_files(rows, extensions, exclude_dirs, min_size, F.expr("ltrim('/', substring(path, length(source) + 1))"))


def into_catalog(stream: DataFrame, catalog: Catalog, checkpoint: str):
    """Starts a query that upserts each batch into images, and returns it. A batch told twice changes nothing the second time."""

    def take(batch: DataFrame, _: int) -> None:
        new = first_per(conform(catalog.with_ids(batch), "images"), ["path"], [F.desc("mtime")])
        catalog.replace("images", upsert(catalog.read("images"), new, ["path"]))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events, users and value by window and type, late rows waited for; the same for a stream and a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
