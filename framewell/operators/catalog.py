"""The catalog: tables as versions of Parquet folders under one root, in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.operators import display, scan, search, selection, thumbs
from framewell.operators.dedup import merge_groups_keeping_flags
from framewell.operators.stats import db_stats
from framewell.schema import CHILDREN, KEYS, TABLES, conform

KEPT_VERSIONS = 2


class Catalog:
    """One writer at a time. A table's current version is the last one written whole; readers of older ones go on."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._index = spark, root.rstrip("/"), (None, None)
        self.runs = f"{self.root}/runs"  # of work in batches that is not done

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self, table: str) -> list[int]:
        fs, folder = self._fs(f"{self.root}/{table}")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.root}/{table}/{n}/_SUCCESS")[1]))

    def read(self, table: str) -> DataFrame:
        found = self.versions(table)
        base = conform(self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{table}/v{found[-1]}"), table) if found else self.spark.createDataFrame([], TABLES[table])
        fs, folder = self._fs(self._parts(table))
        if not fs.exists(folder):
            return base
        done = [s.getPath().toString() for s in fs.listStatus(folder) if fs.exists(self._fs(f"{s.getPath().toString()}/_SUCCESS")[1])]
        if not done:
            return base
        parts = self.spark.read.option("basePath", self._parts(table)).parquet(*done)
        both = base.withColumn("part", F.lit(-1).cast("long")).unionByName(conform(parts, table, "part"))
        return scan.first_per(both, KEYS[table], [F.desc("part")]).drop("part")

    def _parts(self, table: str) -> str:
        """Where parts lie that are newer than the current version."""
        return f"{self.root}/{table}/parts-v{(self.versions(table) or [0])[-1]}"

    def append(self, table: str, rows: DataFrame, part: int) -> None:
        """Adds rows as a part: of rows with equal keys the one of the latest part counts, and `part` written again counts
        once. The table itself is not written; `compact` does that."""
        unique = scan.first_per(conform(rows, table), KEYS[table], KEYS[table])
        unique.write.mode("overwrite").parquet(f"{self._parts(table)}/part={part}")

    def compact(self, table: str) -> None:
        """Writes the table with its parts as one version."""
        folder = self._parts(table)
        fs, path = self._fs(folder)
        if fs.exists(path):
            self.replace(table, self.read(table))
            fs.delete(path, True)

    def replace(self, table: str, rows: DataFrame) -> None:
        """Writes the next version, then drops those before the last KEPT_VERSIONS."""
        found = self.versions(table)
        conform(rows, table).write.mode("overwrite").parquet(f"{self.root}/{table}/v{found[-1] + 1 if found else 1}")
        for v in found[: -KEPT_VERSIONS + 1]:
            fs, path = self._fs(f"{self.root}/{table}/v{v}")
            fs.delete(path, True)

    def upsert(self, table: str, rows: DataFrame, order: list | None = None) -> None:
        """Rows in place of those with equal keys; of new rows that share a key the last by `order` (else any one)."""
        keys = KEYS[table]
        new = scan.first_per(conform(rows, table), keys, order or keys)
        self.replace(table, scan.upsert(self.read(table), new, keys))

    def delete(self, table: str, rows: DataFrame, keys: list[str] | None = None) -> None:
        keys = keys or KEYS[table]
        self.replace(table, self.read(table).join(rows.select(*keys).distinct(), keys, "left_anti"))

    def clear(self) -> None:
        self.drop_index()
        for folder in [*(f"{self.root}/{table}" for table in TABLES), self.runs]:
            fs, path = self._fs(folder)
            fs.delete(path, True)

    # images
    @staticmethod
    def with_ids(files: DataFrame) -> DataFrame:
        return files if "image_id" in files.columns else files.withColumn("image_id", F.xxhash64("path"))

    def save_images(self, files: DataFrame) -> None:
        """Replaces all images, one a path, and empties what belonged to the old ones and the failures."""
        rows = scan.first_per(conform(self.with_ids(files), "images"), ["path"], ["image_id"])
        self.replace("images", rows)
        for table in (*CHILDREN, "failed_files"):
            self.replace(table, self.read(table).limit(0))

    def update_images(self, files: DataFrame, source: str | None = None) -> DataFrame:
        """Takes in a scan of a root and returns its diff; rows of removed images go from the child tables as well."""
        new, old = conform(self.with_ids(files), "images"), self.read("images")
        diff = scan.snapshot_diff(new, old, source)
        self.replace("images", scan.merge_snapshot(new, old, source))
        for table in CHILDREN:
            if self.versions(table):
                self.replace(table, scan.surviving(self.read(table), self.read("images")))
        return diff

    def update_dimensions(self, sizes: DataFrame) -> None:
        """sizes: path, width, height."""
        new = sizes.select("path", F.col("width").alias("_w"), F.col("height").alias("_h"))
        rows = self.read("images").join(new, "path", "left").withColumn("width", F.coalesce("_w", "width")).withColumn("height", F.coalesce("_h", "height"))
        self.replace("images", rows)

    def dimensions(self, path: str) -> tuple[int, int] | None:
        row = self.read("images").filter((F.col("path") == path) & (F.col("width") != 0) & (F.col("height") != 0)).select("width", "height").first()
        return (row["width"], row["height"]) if row else None

    def by_path(self, rows: DataFrame) -> DataFrame:
        """rows keyed by path with their image_id; unknown paths fall out."""
        return rows.join(self.read("images").select("path", "image_id"), "path").drop("path")

    # what is computed from images
    def save_hashes(self, rows: DataFrame, incremental: bool = True) -> None:
        (self.upsert if incremental else self.replace)("image_hashes", self.by_path(rows))

    def save_embeddings(self, rows: DataFrame, incremental: bool = True) -> None:
        (self.upsert if incremental else self.replace)("embeddings", self.by_path(rows))

    def embeddings_without_duplicates(self) -> DataFrame:
        gone = self.read("dedup_groups").filter("is_canonical = 0").select("image_id")
        return self.read("embeddings").join(self.read("images").select("image_id"), "image_id").join(gone, "image_id", "left_anti")

    def search_index(self) -> DataFrame:
        """The vectors that searches meet, at unit length and in memory; made anew once a table behind them has a new version."""
        behind = [(t, self.versions(t)[-1:]) for t in ("embeddings", "images", "dedup_groups")]
        if self._index[0] != behind:
            self.drop_index()
            self._index = (behind, search.normalised_index(self.embeddings_without_duplicates().select("image_id", "vector")))
        return self._index[1]

    def drop_index(self) -> None:
        if self._index[1] is not None:
            self._index[1].unpersist()
        self._index = (None, None)

    def save_groups(self, groups: DataFrame, incremental: bool = True) -> None:
        self.replace("dedup_groups", merge_groups_keeping_flags(self.read("dedup_groups"), groups) if incremental else groups)

    def save_clusters(self, rows: DataFrame) -> None:
        self.replace("clusters", rows.withColumn("name", F.when(F.col("cluster_id") == -2, "garbage").otherwise(F.col("name") if "name" in rows.columns else F.lit(""))))

    def save_garbage(self, images: DataFrame) -> None:
        self.replace("clusters", display.mark_garbage(self.read("clusters"), images))

    def save_failed(self, rows: DataFrame, incremental: bool = True) -> None:
        (self.upsert if incremental else self.replace)("failed_files", rows)

    def save_selected(self, paths: DataFrame, scope: str = "global") -> None:
        self.replace("selected_files", selection.save_scope(self.read("selected_files"), paths, scope))

    def save_thumbnails(self, rows: DataFrame) -> None:
        self.upsert("thumbnails", rows)

    def thumbnail(self, path: str, mtime: float, size: int) -> bytes | None:
        row = self.read("thumbnails").filter((F.col("path") == path) & (F.col("mtime") == mtime) & (F.col("size") == size)).select("blob").first()
        return bytes(row["blob"]) if row and row["blob"] is not None else None

    def missing_thumbnails(self, limit: int | None = None) -> DataFrame:
        return thumbs.missing(self.read("images"), self.read("thumbnails"), limit)

    def delete_images(self, paths: DataFrame) -> None:
        """Takes paths out of images, what belongs to them, and the thumbnails."""
        self.delete("images", paths, ["path"])
        self.delete("thumbnails", paths, ["path"])
        for table in CHILDREN:
            if self.versions(table):
                self.replace(table, scan.surviving(self.read(table), self.read("images")))

    def stats(self) -> DataFrame:
        return db_stats(self.read("images"), self.read("dedup_groups"), self.read("clusters"))
