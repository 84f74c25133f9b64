"""Files as tables: listings, pictures, and a stream of new ones.

Spark's file sources pass over names that begin with a dot or an underscore, and so do these.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.config import CONFIG, EXTENSIONS
from framewell.functions.exif import orientation
from framewell.operators.scan import select_files

#: Up to so many files of a root are decoded one by one instead of with all others of the root.
FEW_FILES = 10_000
#: Bytes in which a file tells how its camera was held: segments before it take 64 KB each.
HEAD_BYTES = 1 << 18

LISTING = "path string, modificationTime timestamp, length long, content binary"


def _glob(extensions: list[str] | None) -> str:
    """Extensions in either case, as a listing pattern."""
    names = [x.lower().lstrip(".") for x in (extensions or EXTENSIONS)]
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in names) + "}"


def _path(column: str = "path") -> Column:
    """A listed file's path without the local scheme; other stores keep theirs."""
    return F.regexp_replace(F.col(column), r"^file:/*", "/")


def listing(spark: SparkSession, roots: list[str], extensions: list[str] | None = None) -> DataFrame:
    """(path, size, mtime, source) of the files under the roots; contents are not read. A missing root has none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(extensions)).option("ignoreMissingFiles", True)
    out = None
    for root in roots:
        rows = reader.load(root).select(_path().alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.lit(root.rstrip("/") or "/").alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "path string, size long, mtime double, source string")


def scan(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, exclude_dirs: list[str] | None = None, min_size: int = CONFIG.min_size) -> DataFrame:
    """The files that the catalog takes in. Excluded directories are asked below each root, not in its own name."""
    rows = listing(spark, roots, extensions)
    relative = F.expr("ltrim('/', substring(path, length(source) + 1))")
    return select_files(rows, extensions, exclude_dirs, min_size, relative)


def pictures(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files (path, ...) with their contents, null where a file is gone. The paths are joined to a listing of their folders."""
    roots = [r["root"] for r in files.select(F.coalesce(F.col("source") if "source" in files.columns else F.lit(None), F.regexp_replace("path", "/[^/]*$", "")).alias("root")).distinct().collect()]
    content = None
    for root in roots:  # one a scanned root
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root).select(_path().alias("path"), "content")
        content = rows if content is None else content.unionByName(rows)
    return files.withColumn("content", F.lit(None).cast("binary")) if content is None else files.join(content, "path", "left")


def names_in(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files that stand in a folder; a missing folder has none."""
    rows = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "name string")
    return rows.load(folder).select(F.regexp_extract(_path(), "([^/]*)$", 1).alias("name"))


def _all_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)


def decoded(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """(path, height, width, channels, mode, data) of the pictures under a folder that the JVM can decode.

    only: the paths that are asked for. The picture source decodes whatever it is given, so a few of them are given by
    name, after a listing without contents; with more, the root is decoded and the others fall out.
    """
    reader = spark.read.format("image").option("dropInvalid", True)
    if only is not None:
        there = _all_files(spark, root).select(F.col("path").alias("_listed"), _path().alias("path")).join(only.select("path").distinct(), "path", "left_semi")
        names = [r["_listed"] for r in there.limit(FEW_FILES + 1).select("_listed").collect()]
        if not names:
            return spark.createDataFrame([], "path string, height int, width int, channels int, mode int, data binary")
        if len(names) <= FEW_FILES:
            return _unpacked(reader.load([re.sub(r"([\\\[\]{}*?])", r"\\\1", n) for n in names]))
    rows = _unpacked(reader.option("recursiveFileLookup", True).load(root))
    return rows if only is None else rows.join(only.select("path").distinct(), "path", "left_semi")


def _unpacked(rows: DataFrame) -> DataFrame:
    # the picture source escapes its paths, other than the listing
    origin = F.url_decode(F.regexp_replace(_path("image.origin"), r"\+", "%2B"))
    return rows.select(origin.alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.mode", "image.data")


def orientations(files: DataFrame) -> DataFrame:
    """(path, orientation) of files (path, content) whose camera was turned; the tag stands in a file's first bytes."""

    def run(batches):
        for b in batches:
            found = [(p, k) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (k := orientation(c)) != 1]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32())], names=["path", "orientation"])

    return files.select("path", F.substring("content", 1, HEAD_BYTES).alias("content")).mapInArrow(run, "path string, orientation int")
