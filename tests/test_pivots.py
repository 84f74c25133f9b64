import numpy as np
import pytest

from framewell.operators import neighbours
from framewell.plans import pivots


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, vector array<double>")


def clustered(rng, n, dims=8):
    """Clusters of unequal density, with a third of all rows equal."""
    centres = rng.normal(0, 10, (12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, dims)) * rng.choice([0.05, 0.3, 1.0], n)[:, None]
    x[: n // 3] = x[0]
    return x


@pytest.mark.parametrize("itself", [True, False])
def test_neighbours_by_blocks_are_exact_and_meet_few(spark, itself):
    x = clustered(np.random.default_rng(1), 600)
    df = frame(spark, x)
    k = 4
    far = np.array([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in x])
    if not itself:
        np.fill_diagonal(far, np.inf)
    want = {(i, r + 1): (int(j), far[i, j]) for i in range(0, 600) for r, j in enumerate(np.lexsort((np.arange(600), far[i]))[:k])}
    got = {(r.query_id, r["rank"]): (r.image_id, r.distance) for r in neighbours.knn_join(df, df, k, itself, block=16).collect()}
    assert got == want
    assert neighbours.meetings(df, df, k, itself, block=16).share() < 0.2


def test_other_queries_and_few_rows(spark):
    rng = np.random.default_rng(2)
    x, q = clustered(rng, 200, 3), rng.normal(0, 10, (40, 3))
    asked = spark.createDataFrame([(1000 + i, v.tolist(), "x") for i, v in enumerate(q)], "image_id long, vector array<double>, rows string")
    got = {(r.query_id, r["rank"]): r.image_id for r in neighbours.knn_join(asked, frame(spark, x), 7, block=8).collect()}
    for i, v in enumerate(q):
        far = np.sqrt(((x - v) ** 2).sum(axis=1))
        assert [got[1000 + i, r + 1] for r in range(7)] == np.lexsort((np.arange(200), far))[:7].tolist()
    few = neighbours.knn_join(asked, frame(spark, x[:3]), 7, block=2)
    assert few.count() == 3 * 40
    alone = neighbours.knn_join(frame(spark, x[:1]), frame(spark, x[:1]), 2, itself=False)
    assert alone.count() == 0


def test_no_block_is_larger_and_bounds_hold(spark):
    x = clustered(np.random.default_rng(3), 500)
    df = frame(spark, x)
    chosen = pivots.choose_pivots(df, 500, 25)
    blocks = pivots.partition(df, chosen, 500, 25)
    assert blocks.n.max() <= 25 and blocks.n.sum() == 500
    rows = {r.block: [m.image_id for m in r.rows] for r in blocks.rows.collect()}
    bound = blocks.bounds(pivots.distances(x, chosen))
    for k, number in enumerate(blocks.numbers):
        assert (bound[:, k] <= pivots.distances(x, x[rows[int(number)]]).min(axis=1)).all()


def test_no_block_is_copied_for_those_it_meets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 12))  # without structure: all blocks meet
    x[500:510], x[510] = x[3], np.nan
    df = frame(spark, x)
    for part in (pivots.PART, 9000):
        monkeypatch.setattr(pivots, "PART", part)
        found = neighbours.knn_join(df, df, 5, block=32)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "HashJoin" not in plan
        got = {(r.query_id, r["rank"]): (r.image_id, r.distance) for r in found.collect()}
        for i in [*range(0, 510, 7), 599]:
            far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            far[510] = np.inf
            assert [got[i, r + 1] for r in range(5)] == [(int(j), far[j]) for j in np.lexsort((np.arange(600), far))[:5]]
        assert not any(q == 510 or j == 510 for (q, _), (j, _) in got.items())


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e30])
def test_the_table_of_a_product_is_off_by_no_more_than_it_says(scale):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, (80, 64)) * scale + 50 * scale, rng.normal(0, 1, (90, 64)) * scale + 50 * scale
    b[:9] = a[:9]
    far, off, unit = pivots.squared(a, b)
    exact = pivots.distances(a, b)
    assert (np.abs(far - (exact / unit) ** 2) <= off[:, None]).all()
    most = np.partition(exact, 4, axis=1)[:, 4]
    hit = pivots.within((far, off, unit), most)
    assert hit[exact <= most[:, None]].all() and hit.sum() < 600
    i, j = np.nonzero(hit)
    assert (pivots.pair_distances(a, b, i, j) == exact[i, j]).all()
    assert pivots.squared(np.array([[np.nan]]), np.zeros((1, 1))) is None
