"""Small pieces that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and white space as the contracts name them.
WORD = r"[^\x20\x09-\x0D]+"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows from now on, unless the caller chose a size: whole texts make Spark's 10,000 large."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for work that turns one batch into dicts of columns, one dict an output batch."""
    names = [x.split()[0] for x in schema.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for out in work(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], k) if not isinstance(out[n], pa.Array) else out[n].cast(k) for n, k in zip(names, kinds, strict=True)], names=names)

    return df.mapInArrow(run, schema)
