"""Carrying out plans of moves and copies on a file system that all executors mount."""

from __future__ import annotations

import errno
import filecmp
import os
import shutil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.operators.names import unique_names


def export_plan(selected: DataFrame, images: DataFrame, folder: str, taken: DataFrame | None = None) -> DataFrame:
    """(src, dst, size) for the selected paths, by path, with names free of collisions (also with those in `taken`)."""
    rows = unique_names(images.join(selected.select("path").distinct(), "path", "left_semi").select("path", "size"), taken)
    return rows.select(F.col("path").alias("src"), F.concat(F.lit(folder.rstrip("/") + "/"), F.col("unique_name")).alias("dst"), "size")


def carried_out(plan: DataFrame, move: bool = False) -> DataFrame:
    """(src, dst, size, done) after each file is copied or moved. No file is ever written over: a target that stands
    already and holds something else is a failure, and its source stays. A task that runs again finds its work done: a file
    is written under a name of its own and then given the target's, and a target that holds the source's bytes, or stands
    with the source gone, counts as carried."""

    def placed(part: str, dst: str) -> None:
        try:
            os.link(part, dst)  # fails where the target stands
        except OSError as e:
            if e.errno == errno.EEXIST:
                raise
            with open(part, "rb") as data, open(dst, "xb") as out:  # a file system without links
                shutil.copyfileobj(data, out)
            shutil.copystat(part, dst)

    def one(src: str, dst: str) -> bool:
        part = f"{dst}.part{os.getpid()}"
        try:
            if move and not os.path.exists(src):
                return os.path.exists(dst)
            if os.path.lexists(dst):
                if os.path.samefile(src, dst) or not filecmp.cmp(src, dst, shallow=False):
                    return False
            else:
                os.makedirs(os.path.dirname(dst), exist_ok=True)
                shutil.copy2(src, part)
                placed(part, dst)
            if move:
                os.remove(src)
            return True
        except OSError:
            return False
        finally:
            if os.path.exists(part):
                os.remove(part)

    def run(batches):
        for b in batches:
            done = [one(s, d) for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.bool_())], names=["src", "dst", "size", "done"])

    return plan.select("src", "dst", F.col("size").cast("long").alias("size")).mapInArrow(run, "src string, dst string, size long, done boolean")


def totals(done: DataFrame) -> DataFrame:
    """One row: files carried, their bytes, and failures."""
    ok = F.when(F.col("done"), F.col("size"))
    return done.agg(F.count(ok).alias("files"), F.coalesce(F.sum(ok), F.lit(0)).alias("bytes"), F.count(F.when(~F.col("done"), 1)).alias("failed"))
