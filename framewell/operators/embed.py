"""Embedding of pictures or texts by a model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.config import CONFIG
from framewell.functions.exif import turned
from framewell.functions.vectors import l2_normalised
from framewell.operators.scan import stale

_MODELS: dict[bytes, Callable] = {}


def loaded(model: bytes) -> Callable:
    """The model that a pickled load() brings, made once in a worker: load() returns encode(inputs) -> vectors.

    Tasks get load() pickled and find this function by its name, so all tasks of a worker share one cache. Models are
    told apart by the bytes that load() pickles to.
    """
    if model not in _MODELS:
        _MODELS.clear()  # a worker has room for one
        _MODELS[model] = cloudpickle.loads(model)()
    return _MODELS[model]


def seen(value):
    """A model's input: a decoded picture (height, width, channels, data, orientation) as upright rows of points, anything
    else as it is; None for a picture whose sizes and bytes disagree."""
    if not isinstance(value, dict):
        return value
    try:
        raster = np.frombuffer(value["data"], np.uint8).reshape(value["height"], value["width"], value["channels"])
    except (TypeError, ValueError):
        return None
    return turned(raster, value["orientation"])


def embed(rows: DataFrame, load: Callable[[], Callable[[list], list]], column: str = "content", batch: int = CONFIG.embed_batch) -> DataFrame:
    """(image_id, vector, mtime) of the rows; where a batch fails its rows are tried one by one, and those that fail are left out.

    A column of decoded pictures reaches the model as upright arrays.
    """

    def encode(model, values: list) -> list:
        try:
            return list(model(values))
        except Exception:
            if len(values) == 1:
                return [None]
            return [v for x in values for v in encode(model, [x])]

    pickled = cloudpickle.dumps(load)

    def run(batches):
        from framewell.operators import embed as shared  # by name: the cache is the worker's, not the task's

        model = shared.loaded(pickled)
        for b in batches:
            rows_in = [(i, m, x) for i, m, v in zip(*(c.to_pylist() for c in b.columns), strict=True) if (x := shared.seen(v)) is not None]
            ids, mtimes, values = zip(*rows_in, strict=True) if rows_in else ((), (), ())
            vectors = [v for k in range(0, len(values), batch) for v in encode(model, list(values[k : k + batch]))]
            kept = [k for k, v in enumerate(vectors) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in kept], pa.int64()), pa.array([[float(x) for x in vectors[k]] for k in kept], pa.list_(pa.float32())), pa.array([mtimes[k] for k in kept], pa.float64())],
                names=["image_id", "vector", "mtime"],
            )

    return rows.filter(F.col(column).isNotNull()).select("image_id", "mtime", column).mapInArrow(run, "image_id long, vector array<float>, mtime double")


def embed_stale(images: DataFrame, saved: DataFrame, duplicates: DataFrame, failed: DataFrame, load, read, column: str = "content") -> DataFrame:
    """New vectors of images that need one; read(images) adds the model's input. Upsert the result."""
    return embed(read(stale(images, saved, duplicates, failed)), load, column)


def query_vector(load: Callable, text: str) -> list[float]:
    """A query's vector at unit length."""
    vector = [float(x) for x in load()([text])[0]]
    size = sum(x * x for x in vector) ** 0.5 or 1.0
    return [x / size for x in vector]


def unit_vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", l2_normalised(F.col("vector")))
