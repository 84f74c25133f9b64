import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.operators import cluster, layout


def nearest(x, k):
    far = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, :k]
    return order, np.sqrt(np.take_along_axis(far, order, 1))


def kept(high, low):
    return float(np.mean([len(set(a) & set(b)) / len(a) for a, b in zip(high, low)]))


def placed(df):
    return np.array([r["vector"] for r in df.orderBy("image_id").collect()])


def plain(x, components, k, steps, start):
    """The same walk as a dense matrix, orthonormal after every step."""
    order, far = nearest(x, k)
    w = np.zeros((len(x), len(x)))
    for i, (js, ds) in enumerate(zip(order, far)):
        w[i, js] = np.maximum(np.exp(-(ds**2) / np.maximum(far[i, -1] * far[js, -1], 1e-24)), layout.LEAST)
    w = np.maximum(w, w.T)
    root = np.sqrt(w.sum(axis=1))
    m = (w / np.outer(root, root) + np.eye(len(x))) / 2
    q = np.linalg.qr((start - start.mean(axis=0)) * root[:, None])[0]
    top = root / np.linalg.norm(root)
    for _ in range(steps):
        q = m @ q
        q = np.linalg.qr(q - np.outer(top, top @ q))[0]
    values, turn = np.linalg.eigh(q.T @ m @ q)
    return (q @ turn)[:, ::-1][:, :components] / root[:, None]


@pytest.fixture(scope="module")
def unit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 24))[rng.integers(0, 8, 320)] + rng.normal(size=(320, 24)) * 0.3
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, vector array<double>")


def test_layout_is_that_of_the_dense_walk_and_keeps_more_neighbours_than_components(spark, unit, monkeypatch):
    df = frame(spark, unit)
    got = placed(layout.learned_layout(df, 3, 12))
    want = plain(unit, 3, 12, layout.STEPS, placed(cluster.reduced(df, 3 + layout.SPARE)))
    want = want - want.mean(axis=0)
    for j in range(3):
        assert abs(np.corrcoef(got[:, j], want[:, j])[0, 1]) > 1 - 1e-6
    assert np.sqrt((got**2).sum(axis=1).mean()) == pytest.approx(1)
    high = nearest(unit, 12)[0]
    assert kept(high, nearest(got, 12)[0]) > kept(high, nearest(placed(cluster.reduced(df, 3)), 12)[0])
    monkeypatch.setattr(layout, "BROADCAST", 0)
    assert np.allclose(got, placed(layout.learned_layout(df.repartition(3), 3, 12)), atol=1e-8)


def test_layout_of_copies_few_rows_nulls_and_none(spark, unit):
    copies = frame(spark, np.vstack([np.repeat(unit[:1], 60, axis=0), unit[1:60]]))
    got = placed(layout.learned_layout(copies, 2, 5))
    assert got.shape == (119, 2) and np.isfinite(got).all()
    few = layout.learned_layout(frame(spark, unit[:4]), 3)
    assert placed(few).shape == (4, 3)
    none = frame(spark, unit[:40]).withColumn("vector", F.when(F.col("image_id") > 2, F.col("vector")))
    assert layout.learned_layout(none, 2, 5).count() == 37
    assert layout.learned_layout(frame(spark, unit[:0])).count() == 0
