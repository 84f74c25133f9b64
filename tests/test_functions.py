import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell import config
from framewell.functions import hashes, paths, vectors
from framewell.functions.phash import grey, phash, shrunk


def one(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_sizes_and_limits():
    assert [config.min_cluster_size(n) for n in (10, 99, 100, 999, 1000, 4999, 5000)] == [3, 4, 5, 19, 10, 24, 15]
    assert [config.sub_min_cluster_size(n) for n in (10, 100, 1000)] == [5, 10, 20]
    assert [config.bands_for(r) for r in (0, 6, 7, 10, 64)] == [8, 8, 8, 11, 64] and config.min_shared_bands(6, 8) == 2


@pytest.mark.parametrize(("n", "shown"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1 << 20, "1.0 MB"), ((1 << 30) - 1, "1024.0 MB"), (1 << 30, "1.00 GB"), (None, "0 B")])
def test_format_size(spark, n, shown):
    assert one(spark, (n,), "n long", paths.format_size(F.col("n"))) == shown


def test_format_size_of_no_number(spark):
    assert one(spark, ("many",), "n string", paths.format_size(F.col("n"))) == "0 B"


@pytest.mark.parametrize(("name", "ext", "stem"), [("a.JPG", "jpg", "a"), (".jpg", "jpg", ".jpg"), ("noext", "", "noext"), ("a.b.c", "c", "a.b"), ("..x", "x", "..x")])
def test_names(spark, name, ext, stem):
    assert one(spark, (name,), "n string", paths.extension(F.col("n"))) == ext
    assert one(spark, (name,), "n string", paths.stem(F.col("n"))) == stem
    assert one(spark, (name,), "n string", F.concat(paths.stem(F.col("n")), paths.suffix(F.col("n")))) == name


@pytest.mark.parametrize(("path", "out"), [("a/NODE_modules/b.jpg", True), ("tmp.jpg", False), ("tmp/x.jpg", True), ("x/tmp", False), ("mine/x.jpg", True), ("a/b.jpg", False)])
def test_excluded_directories(spark, path, out):
    assert one(spark, (path,), "p string", paths.in_excluded_dir(F.col("p"), ["MINE"])) is out


def test_hash_views(spark):
    for h in (0, -1, 2**63 - 1, -(2**63), 1234567890123456789, -987654321):
        back = one(spark, (h,), "h long", hashes.signed(hashes.unsigned(F.col("h"))))
        assert back == h
        assert int(one(spark, (h,), "h long", hashes.unsigned(F.col("h")))) == h % 2**64
        bits = [h >> (63 - k) & 1 for k in range(64)]
        assert one(spark, (bits,), "b array<int>", hashes.from_bits(F.col("b"))) == h
        for n in (8, 10, 64):
            values, left = one(spark, (h,), "h long", hashes.band_values(F.col("h"), n)), ""
            for k, v in enumerate(values):
                left += format(v, f"0{64 // n + (k < 64 % n)}b")
            assert int(left, 2) == h % 2**64


def test_vectors(spark):
    assert one(spark, ([3.0, 4.0],), "v array<float>", vectors.l2_normalised(F.col("v"))) == pytest.approx([0.6, 0.8])
    assert one(spark, ([0.0, 0.0],), "v array<float>", vectors.l2_normalised(F.col("v"))) == [0.0, 0.0]
    assert one(spark, ([1.0, 2.0],), "v array<float>", vectors.distance(F.col("v"), vectors.constant([4, 6]))) == 5.0


def test_picture_hash():
    rng = np.random.default_rng(1)
    base = np.kron(rng.integers(0, 256, (8, 8, 3), dtype=np.uint8), np.ones((8, 8, 1), np.uint8))
    apart = lambda other: (phash(base) ^ phash(other)).bit_count()
    assert apart(np.kron(base, np.ones((2, 3, 1), np.uint8))) <= 2 and apart(base[:, ::-1]) > 12
    assert apart(np.clip(base.astype(int) + rng.integers(-2, 3, base.shape), 0, 255).astype(np.uint8)) <= 6
    assert -(2**63) <= phash(np.zeros((8, 8, 1), np.uint8)) < 2**63


#: Of made_pictures(), from plain_shrink and a plain cosine transform.
HASHES = [-7770021429821183434, -2592951866375797932, -4067820879178307800, -3063221264845045507, -7464208225237752452]


def plain_shrink(image, side=32):
    """The same filter point by point."""

    def line(values):
        n, out = len(values), []
        step = n / side
        wide = max(step, 1.0)
        for k in range(side):
            centre = (k + 0.5) * step
            low, high = max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))
            x = [(j - centre + 0.5) / wide for j in range(low, high)]
            w = [(1.0 if v == 0 else 3 * math.sin(math.pi * v) * math.sin(math.pi * v / 3) / (math.pi * v) ** 2) if abs(v) < 3 else 0.0 for v in x]
            whole = [round(v / sum(w) * 2**22) for v in w]
            out.append(min(255, max(0, (sum(int(p) * v for p, v in zip(values[low:high], whole, strict=True)) + 2**21) >> 22)))
        return out

    rows = [line(r) for r in image.tolist()]
    return np.array([line(list(c)) for c in zip(*rows, strict=True)]).T


def made_pictures():
    rng = np.random.default_rng(11)
    y, x = np.mgrid[0:120, 0:90]
    yield ((x * 2 + y) % 256).astype(np.uint8)
    yield (127 + 120 * np.sin(x / 5) * np.cos(y / 9)).astype(np.uint8)
    yield rng.integers(0, 256, (57, 200)).astype(np.uint8)
    yield np.where((x // 7 + y // 11) % 2, 250, 3).astype(np.uint8)
    yield rng.integers(0, 256, (20, 17)).astype(np.uint8)  # enlarged


def test_hash_takes_a_windowed_sinc():
    means = []
    for image in made_pictures():
        got = shrunk(image.astype(np.int64))
        assert (got == plain_shrink(image)).all() and got.shape == (32, 32)
        edges = [np.linspace(0, n, 33) for n in image.shape]
        area = [np.array([[max(0.0, min(j + 1, e[k + 1]) - max(j, e[k])) for j in range(n)] for k in range(32)]) * 32 / n for e, n in zip(edges, image.shape)]
        means.append(np.abs(area[0] @ image @ area[1].T - got).max())
    assert max(means) > 8  # the mean over areas is another filter
    assert [phash(i[:, :, None]) for i in made_pictures()] == HASHES
    assert (grey(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], np.uint8)) == [[29, 150, 76, 255]]).all()
