import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from framewell import api
from framewell.operators.catalog import Catalog
from framewell.streaming import batches


def written(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def test_a_run_that_breaks_off_goes_on(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "catalog"))
    cat.replace("embeddings", spark.createDataFrame([(1, [9.0], 0.0), (500, [9.0], 0.0)], "image_id long, vector array<float>, mtime double"))
    todo = spark.range(100).select(F.col("id").alias("image_id"), F.lit(1.0).alias("mtime"))
    done = []

    def work(batch, stop=True):
        ids = [r.image_id for r in batch.collect()]
        if stop and len(done) == 3:
            raise RuntimeError("lost")
        done.append(ids)
        return batch.select("image_id", F.array(F.col("image_id").cast("float")).alias("vector"), "mtime")

    with pytest.raises(StreamingQueryException):
        batches.in_batches(cat, "t", "embeddings", work, todo, 10)
    assert batches.pending(cat, "t") and cat.versions("embeddings") == [1]
    part = cat.read("embeddings")  # what is done can be read, the last one of equal keys counts
    assert part.count() == 1 + sum(map(len, done)) + (1 not in sum(done, []))
    batches.in_batches(cat, "t", "embeddings", lambda b: work(b, False))
    assert sorted(sum(done, [])) == list(range(100))  # nothing twice
    rows = {r.image_id: r.vector for r in cat.read("embeddings").collect()}
    assert rows == {**{i: [float(i)] for i in range(100)}, 500: [9.0]}
    assert not batches.pending(cat, "t") and cat.versions("embeddings") == [1, 2]
    assert not os.path.exists(f"{cat.root}/embeddings/parts-v1")


def test_parts_count_once_and_are_compacted(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "catalog"))
    frame = lambda rows: spark.createDataFrame(rows, "path string, reason string")
    for part, rows in ((0, [("a", "x"), ("b", "x")]), (1, [("a", "y")]), (0, [("a", "z"), ("b", "z")])):
        cat.append("failed_files", frame(rows), part)
    want = [("a", "y"), ("b", "z")]
    assert sorted(tuple(r) for r in cat.read("failed_files").collect()) == want
    cat.compact("failed_files")
    cat.compact("failed_files")
    assert sorted(tuple(r) for r in cat.read("failed_files").collect()) == want and cat.versions("failed_files") == [1]


def test_groups_are_left_alone_if_nothing_is_new(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "catalog"))
    images = spark.range(8).select(F.col("id").alias("image_id"), F.concat(F.lit("/p"), "id").alias("path"), F.lit(1.0).alias("mtime"))
    cat.replace("images", images)
    cat.replace("image_hashes", images.select("image_id", F.expr("cast(4095 * pow(4096, image_id div 2) as long)").alias("phash"), "mtime"))
    assert api.regroup(cat) and not api.regroup(cat)
    first, version = sorted(tuple(r) for r in cat.read("dedup_groups").collect()), cat.versions("dedup_groups")
    assert len(first) == 8 and not api.regroup(cat) and cat.versions("dedup_groups") == version
    cat.replace("images", images.filter("image_id <> 3"))
    assert api.regroup(cat)
    assert sorted(r.image_id for r in cat.read("dedup_groups").collect()) == [0, 1, 4, 5, 6, 7]
    assert api.regroup(cat, full=True) and api.regroup(cat, radius=3) and cat.read("dedup_groups").count() == 6
