"""Long work in durable batches: a run that breaks off goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from framewell.operators.catalog import Catalog


def _exists(catalog: Catalog, path: str) -> bool:
    fs, where = catalog._fs(path)
    return fs.exists(where)


def pending(catalog: Catalog, name: str) -> bool:
    """Whether a run of this name has begun and not come to its end."""
    return _exists(catalog, f"{catalog.runs}/{name}/todo/_SUCCESS")


def in_batches(catalog: Catalog, name: str, table: str, work: Callable[[DataFrame], DataFrame], todo: DataFrame | None = None, a_batch: int = 100_000) -> None:
    """Appends work(some rows of todo) to a table, about a_batch rows at a time, and compacts the table at the end.

    The rows are written down first, as files of a stream. Each micro-batch takes one file and leaves one part, so what
    is written grows with the rows; the checkpoint knows what is done, and a batch done again writes its part again.
    todo None: goes on with the run that is pending.
    """
    folder = f"{catalog.runs}/{name}"
    if todo is not None:
        parts = max(1, -(-todo.count() // a_batch))
        todo.repartition(parts).write.mode("overwrite").option("maxRecordsPerFile", a_batch).parquet(f"{folder}/todo")
    rows = catalog.spark.read.parquet(f"{folder}/todo")
    stream = catalog.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/todo")

    def take(batch: DataFrame, number: int) -> None:
        catalog.append(table, work(batch), number)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    catalog.compact(table)
    fs, path = catalog._fs(folder)
    fs.delete(path, True)
