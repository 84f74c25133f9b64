import random

from framewell.plans.numbering import row_numbers


def test_places_by_order(spark):
    random.seed(1)
    values = random.sample(range(10_000), 500)
    df = spark.createDataFrame([(v, str(v)) for v in values], "v long, s string").repartition(7)
    got = {r.v: r.number for r in row_numbers(df, ["v"]).collect()}
    assert got == {v: k for k, v in enumerate(sorted(values))}
    assert row_numbers(df.limit(0), ["v"]).count() == 0


def test_ranks_within_a_hot_key(spark):
    """A third of all rows have one key: the same ranks, and no task has more than its share of rows."""
    from pyspark.sql import functions as F

    from framewell.plans.numbering import ranks_within

    keys = ["hot" if k % 3 == 0 else f"k{k % 50}" for k in range(6000)]
    df = spark.createDataFrame([(key, (k * 7919) % 6007) for k, key in enumerate(keys)], "key string, at long").repartition(12)
    rows = ranks_within(df, "key", ["at"], "r").collect()
    # as the rows are dealt there; their tables are too small here for the tasks that read them to tell
    sizes = df.repartitionByRange(12, "key", "at").groupBy(F.spark_partition_id().alias("task")).count().collect()
    order = {}
    for key, at in sorted((r.key, r["at"]) for r in rows):
        order[key, at] = sum(1 for k in order if k[0] == key) if key != "hot" else None
    places = {at: k for k, at in enumerate(sorted(r["at"] for r in rows if r.key == "hot"))}
    assert all(r.r == (places[r["at"]] if r.key == "hot" else order[r.key, r["at"]]) for r in rows)
    assert max(r["count"] for r in sizes) <= 2 * 6000 / 12
