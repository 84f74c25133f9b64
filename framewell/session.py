"""Session helpers shared by every part of the library."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def on_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where the driver found it; a cluster without that folder gets it by --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return on_workers(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-framewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are written: it does so once nobody refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
