import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.operators import cluster, dedup, display, embed, names, neighbours, scan, search, selection, stats, thumbs
from framewell.operators.catalog import Catalog
from framewell.functions.phash import hashed, with_reasons
from framewell.sources import files
from framewell.streaming.ingest import arrivals, counts_by_window, into_catalog


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def bmp(raster):
    h, w, _ = raster.shape
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(raster[k].tobytes() + pad for k in reversed(range(h)))
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tmp") / "root"
    rng = np.random.default_rng(0)
    base = np.kron(rng.integers(0, 256, (8, 8, 3), dtype=np.uint8), np.ones((8, 8, 1), np.uint8))
    for name, data in {
        "a.bmp": bmp(base), "sub/a.BMP": bmp(np.clip(base.astype(int) + 3, 0, 255).astype(np.uint8)), "sub/b c+d%.bmp": bmp(255 - base[::-1]), "TMP/x.bmp": bmp(base), "sub/broken.bmp": b"BM" + b"\0" * 5000,
        "sub/.jpg": b"j" * 5000, "note.txt": b"t" * 5000, "noext": b"n" * 5000, "small.png": b"p" * 10, "é/ü.png": b"p" * 5000,
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def test_scan_of_a_tree(spark, tree):
    got = files.scan(spark, [str(tree)], min_size=1000)
    below = {r.path.removeprefix(str(tree)): r.ext for r in got.collect()}
    assert below == {"/a.bmp": "bmp", "/sub/a.BMP": "bmp", "/sub/b c+d%.bmp": "bmp", "/sub/broken.bmp": "bmp", "/é/ü.png": "png"}
    assert set(rows(got, "source")) == {(str(tree),)}
    assert files.scan(spark, [str(tree)], ["png"], ["É"], 0).count() == 1
    assert "content" not in files.listing(spark, [str(tree)])._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_pictures_are_hashed_and_failures_told(spark, tree):
    images = files.scan(spark, [str(tree)], min_size=1000)
    told = with_reasons(files.pictures(spark, images), hashed(files.decoded(spark, str(tree))))
    got = {r.path.rsplit("/", 1)[1]: r for r in told.collect()}
    assert got["broken.bmp"].reason == got["ü.png"].reason == "corrupt" and got["a.bmp"].reason is None
    assert (got["a.bmp"].width, got["a.bmp"].height) == (64, 64)
    assert (got["a.bmp"].phash ^ got["a.BMP"].phash).bit_count() <= 6 < (got["a.bmp"].phash ^ got["b c+d%.bmp"].phash).bit_count()
    gone = images.limit(1).withColumn("path", F.concat("path", F.lit("x")))
    assert with_reasons(files.pictures(spark, gone), hashed(files.decoded(spark, str(tree)))).first().reason == "not_found"


def test_catalog_life(spark, tree, tmp_path):
    cat = Catalog(spark, str(tmp_path / "catalog"))
    assert cat.read("images").count() == 0
    images = files.scan(spark, [str(tree)], min_size=1000)
    diff = cat.update_images(images, str(tree))
    assert rows(diff.groupBy("status").count(), "status", "count") == [("new", 5)]
    assert cat.update_images(images, str(tree)).filter("status <> 'unchanged'").count() == 0
    cat.save_hashes(images.select("path", F.lit(7).cast("long").alias("phash"), "mtime"))
    cat.save_hashes(images.limit(1).select("path", F.lit(8).cast("long").alias("phash"), "mtime"))
    assert sorted(r.phash for r in cat.read("image_hashes").collect()) == [7] * 4 + [8]
    cat.save_embeddings(images.select("path", F.array(F.lit(1.0)).alias("vector"), "mtime"), incremental=False)
    ids = [r.image_id for r in cat.read("images").orderBy("path").collect()]
    cat.save_groups(spark.createDataFrame([(1, ids[0], 1), (1, ids[1], 0)], "group_id long, image_id long, is_canonical int"))
    assert cat.embeddings_without_duplicates().count() == 4
    cat.save_clusters(spark.createDataFrame([(ids[0], 3), (ids[1], -2)], "image_id long, cluster_id int"))
    cat.save_garbage(spark.createDataFrame([(ids[0],), (ids[3],)], "image_id long"))
    assert rows(cat.read("clusters"), "cluster_id", "name") == [(-2, "garbage")] * 3
    path = cat.read("images").orderBy("path").first()["path"]
    cat.update_dimensions(spark.createDataFrame([(path, 4, 5)], "path string, width int, height int"))
    assert cat.dimensions(path) == (4, 5) and cat.dimensions("none") is None
    cat.save_thumbnails(cat.read("images").select("path", "mtime", "size", F.encode(F.lit("x"), "utf-8").alias("blob")))
    first = cat.read("images").orderBy("path").first()
    assert cat.thumbnail(path, first.mtime, first.size) == b"x" and cat.thumbnail(path, first.mtime + 1, first.size) is None
    assert cat.missing_thumbnails().count() == 0
    cat.save_failed(spark.createDataFrame([("p", None)], "path string, reason string"))
    assert rows(cat.read("failed_files"), "path", "reason") == [("p", "corrupt")]
    cat.save_selected(images.select("path"))
    cat.save_selected(images.limit(2).select("path"), "export")
    assert rows(cat.read("selected_files").groupBy("scope").count(), "scope", "count") == [("export", 2), ("global", 3)]
    assert cat.stats().first().duplicates == 1
    left = images.filter(~F.col("path").contains("sub"))
    assert cat.update_images(left, str(tree)).filter("status = 'removed'").count() == 3
    assert cat.read("image_hashes").count() == 2
    cat.delete_images(left.limit(1).select("path"))
    assert cat.read("images").count() == 1
    cat.save_images(images)
    assert cat.read("image_hashes").count() == 0 and cat.read("images").count() == 5
    assert len(cat.versions("images")) <= 2
    cat.clear()
    assert cat.versions("images") == []


def test_stream_of_files_and_windows(spark, tree, tmp_path):
    cat = Catalog(spark, str(tmp_path / "catalog"))
    for _ in range(2):  # the second run has nothing new
        into_catalog(arrivals(spark, str(tree), min_size=1000), cat, str(tmp_path / "state")).awaitTermination()
        assert cat.read("images").count() == 5
    sf = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(sf)
    table.write.parquet(str(tmp_path / "events"))
    stream = counts_by_window(spark.readStream.schema(table.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("windows"), "window_start", "event_type", "n") == rows(counts_by_window(table), "window_start", "event_type", "n")


def test_diff_of_sources_and_merge_twice(spark):
    schema = "image_id long, path string, size long, ext string, mtime double, source string, width int, height int"
    old = spark.createDataFrame([(1, "/a/1", 5, "x", 1.0, "/a", 7, 8), (2, "/b/2", 5, "x", 1.0, "/b", 0, 0), (3, "/a/3", 5, "x", 1.0004, "/a", 0, 0)], schema)
    new = spark.createDataFrame([(9, "/a/3", 5, "x", 1.0, "/a", 0, 0), (4, "/a/4", 5, "x", 1.0, "/a", 0, 0)], schema)
    assert rows(scan.snapshot_diff(new, old, "/a"), "path", "status") == [("/a/1", "removed"), ("/a/3", "unchanged"), ("/a/4", "new")]
    merged = scan.merge_snapshot(new, old, "/a")
    assert rows(merged, "image_id", "path") == [(2, "/b/2"), (3, "/a/3"), (4, "/a/4")]
    assert rows(scan.merge_snapshot(new, merged, "/a"), *merged.columns) == rows(merged, *merged.columns)
    assert scan.snapshot_diff(new.limit(0), old, "/a").count() == 2  # an emptied root loses its rows


def test_nested_roots(spark):
    df = spark.createDataFrame([("/a",), ("/a/",), ("/a/b",), ("/ab",), ("c/d",), ("c",), ("//e//f/",)], "root string")
    assert rows(scan.without_nested_roots(df), "root") == [("//e//f/",), ("/a",), ("/ab",), ("c",)]
    assert rows(scan.without_nested_roots(df.union(spark.createDataFrame([("/",)], "root string"))), "root") == [("/",), ("c",)]


def test_groups_of_chains_and_edges(spark):
    random.seed(2)
    h = [random.getrandbits(64)]
    for _ in range(80):
        h.append(h[-1] ^ sum(1 << b for b in random.sample(range(64), 6)))
    h += [h[-1] ^ 0x7F, 0, 2**64 - 1, h[3]]  # 7 bits away, extremes, a copy
    signed = [x - 2**64 if x >> 63 else x for x in h]
    df = spark.createDataFrame(list(enumerate(signed)), "image_id long, phash long")
    pairs = {(i, j): (h[i] ^ h[j]).bit_count() for i in range(len(h)) for j in range(i + 1, len(h))}
    want = {(*k, d) for k, d in pairs.items() if d <= 6}
    assert {tuple(r) for r in dedup.near_pairs(df).select("a", "b", "distance").collect()} == want
    assert {(r.a, r.b) for r in dedup.lsh_candidates(df).collect()} >= {k[:2] for k in want}
    got = {r.image_id: r.component for r in dedup.components(df).collect()}
    assert all(got[i] == 0 for i in range(81)) and got[84] == 0
    assert {tuple(r) for r in dedup.near_pairs(df, 8, 10).select("a", "b", "distance").collect()} == {(*k, d) for k, d in pairs.items() if d <= 8}
    assert dedup.components(df.limit(0)).count() == 0
    found = dedup.hash_search(df, signed[3], 6)
    assert rows(found, "image_id", "distance") == sorted(((i, (x ^ h[3]).bit_count()) for i, x in enumerate(h) if (x ^ h[3]).bit_count() <= 6), key=repr)
    assert rows(dedup.hash_search_by_index(dedup.band_index(df), df, signed[3]), "image_id") == rows(found, "image_id")


def test_incremental_groups_see_old_duplicates(spark):
    images = spark.createDataFrame([(i, f"/p{i}", 1, "jpg", float(i), "/", 10, 10) for i in range(4)], "image_id long, path string, size long, ext string, mtime double, source string, width int, height int")
    old = spark.createDataFrame([(0, 0), (1, 63), (2, 1 << 40)], "image_id long, phash long")
    new = spark.createDataFrame([(3, 63 | 63 << 10), (2, (1 << 40) - 1)], "image_id long, phash long")  # like the old duplicate 1 alone; 2 changed
    failed = spark.createDataFrame([], "path string, reason string")
    assert rows(dedup.incremental_groups(images, old, new, failed), "group_id", "image_id", "is_canonical") == [(0, 0, 1), (0, 1, 0), (0, 3, 0)]


def test_kept_groups_keep_their_flags(spark):
    schema = "group_id long, image_id long, is_canonical int"
    old, new = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (5, 7, 1), (5, 8, 0)], schema), spark.createDataFrame([(9, 2, 0), (9, 3, 1)], schema)
    assert rows(dedup.merge_groups(old, new, new.filter("is_canonical = 1")), "group_id", "image_id", "is_canonical") == [(0, 2, 0), (0, 3, 1), (1, 7, 0), (1, 8, 0)]
    assert rows(dedup.merge_groups_keeping_flags(old, new), "group_id", "image_id", "is_canonical") == [(0, 2, 0), (0, 3, 1), (1, 7, 1), (1, 8, 0)]


def test_names_without_collisions(spark):
    paths = ["/1/a.jpg", "/2/a.jpg", "/3/a_1.jpg", "/4/a.jpg", "/5/.x", "/6/.x", "/7/b", "/8/b", "/9/a_1.jpg"]
    got = names.unique_names(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([("b",), ("b_1",)], "name string"))
    told = {r.path: r.unique_name for r in got.collect()}
    assert len(set(told.values())) == len(paths) and not {"b", "b_1"} & set(told.values())
    assert told["/1/a.jpg"] == "a.jpg" and told["/3/a_1.jpg"] == "a_1.jpg" and told["/6/.x"] == ".x_1"


def test_selection(spark):
    s, v = (spark.createDataFrame([(p,) for p in x], "path string") for x in ("abc", "bcd"))
    assert rows(selection.toggle_all(s, v), "path") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(selection.toggle_all(s, v.filter("path <> 'd'")), "path") == [("a",)]
    assert rows(selection.toggle_all(s, v.limit(0)), "path") == rows(s, "path")
    assert rows(selection.toggle(s, v), "path") == [("a",), ("d",)]
    assert display.page_size(4, 3, 100) == 36 and display.page_size(1, 1, 100) == 10 and display.page_size(9, 9, 20) == 20
    assert rows(display.page(s, 99, 2), "path") == [("a",), ("b",)]


def test_search_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [2.0, 0.1])], "image_id long, vector array<float>")
    assert [r.image_id for r in search.semantic_search(v, [1.0, 0.0]).orderBy("rank").collect()] == [1, 4]
    assert search.semantic_search(v, [1.0, 0.0], slack=0).count() == 4 and search.semantic_search(v, [1.0, 0.0], top=1).count() == 1
    assert search.semantic_search(v.filter("image_id = 3"), [1.0, 0.0]).count() == 1 and search.semantic_search(v.limit(0), [1.0, 0.0]).count() == 0


def test_neighbours_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, vector array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {(r.query_id, r["rank"]): r.image_id for r in neighbours.knn_join(df.filter("image_id < 30"), df, 4).collect()}
    assert got == {(i, k + 1): int(j) for i in range(30) for k, j in enumerate(np.argsort(far[i], kind="stable")[:4])}
    assert neighbours.knn_join(df.limit(0), df).count() == 0 and neighbours.knn_join(df, df.limit(0)).count() == 0
    # the spanning tree's weight against Prim's
    core = np.sort(far, axis=1)[:, 3]
    reach = np.maximum(far, np.maximum(core[:, None], core[None]))
    inside, best, total = {0}, reach[0].copy(), 0.0
    while len(inside) < len(x):
        j = min((j for j in range(len(x)) if j not in inside), key=lambda j: best[j])
        total += best[j]
        inside.add(j)
        best = np.minimum(best, reach[j])
    tree = cluster.spanning_tree(df, cluster.core_distances(df, 4)).collect()
    assert len(tree) == 89 and sum(r.weight for r in tree) == pytest.approx(total)


def test_density_clusters_and_rescues(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(4, 0.1, (40, 2)), rng.uniform(-20, 20, (12, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, vector array<double>")
    got = {r.image_id: r.cluster_id for r in cluster.density_labels(df, 10).collect()}
    one, two = ([got[i] for i in part] for part in (range(40), range(40, 80)))
    assert max(one.count(k) for k in set(one) - {-1}) >= 36 and max(two.count(k) for k in set(two) - {-1}) >= 36
    assert max(set(one), key=one.count) != max(set(two), key=two.count) and sum(got[i] == -1 for i in range(80, 92)) >= 9
    labels = spark.createDataFrame([(i, 1 if i < 40 else 2 if i < 75 else -1) for i in range(92)], "image_id long, cluster_id int")
    fixed = {r.image_id: r.cluster_id for r in neighbours.noise_rescue(df, labels).collect()}
    assert all(fixed[i] == 2 for i in range(75, 80)) and sum(fixed[i] == -1 for i in range(80, 92)) >= 9
    assert rows(neighbours.noise_rescue(df, labels, share=0.9), "image_id", "cluster_id") == rows(labels, "image_id", "cluster_id")
    halves = cluster.refine_mega(df, df, labels, 0.4, explode=lambda mine: mine.select("image_id", F.when(F.col("image_id") % 2 == 0, -1).otherwise(1).alias("cluster_id")))
    told = {r.image_id: r.cluster_id for r in halves.collect()}
    assert all(told[i] == (-2 if i % 2 == 0 else 2) for i in range(40)) and told[41] == 2
    assert {r.cluster_id for r in cluster.cluster(df.limit(1)).collect()} == {0} and cluster.cluster(df.limit(12)).select("cluster_id").distinct().count() == 2
    assert cluster.density_labels(df.limit(0), 5).count() == 0


def test_sparse_cluster_beside_dense_ones(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.02, (60, 2)), rng.normal(3, 0.02, (60, 2)), rng.normal((40, -40), 1.0, (12, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, vector array<double>")
    got = {r.image_id: r.cluster_id for r in cluster.density_labels(df, 8).collect()}
    parts = [[got[i] for i in part] for part in (range(60), range(60, 120), range(120, 132))]
    names = [max(set(p) - {-1}, key=p.count, default=-1) for p in parts]
    assert len(set(names)) == 3 and -1 not in names and parts[2].count(names[2]) >= 11


def test_full_buckets_are_dealt_again(spark, monkeypatch):
    """A third of all hashes equal, a third around them, in buckets far fuller than allowed: the same groups and links."""
    rng = np.random.default_rng(8)
    near = [int(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 8)), replace=False))) for _ in range(100)]
    values = [0] * 100 + near + [int(x) for x in rng.integers(0, 1 << 63, 100)]
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(values)), "image_id long, phash long")
    monkeypatch.setattr(dedup, "FULL_BUCKET", 12)
    known = df.select("phash").distinct()
    dealt = dedup.dealt_by_keys(known, 6, 8)
    assert max(r["count"] for r in dealt.groupBy("bucket").count().collect()) <= 30
    far = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    links = {(min(first[x], first[y]), max(first[x], first[y])) for x in first for y in first if x < y and far(x, y) <= 6}
    assert {(r.a, r.b) for r in dedup.class_links(df).collect()} == links
    root = list(range(300))
    for a, b in [*links, *((first[v], i) for i, v in enumerate(values))]:
        a, b = root[a], root[b]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert {r.image_id: r.component for r in dedup.components(df).collect()} == dict(enumerate(root))
    assert [dedup.bands_for_count(n, 6) for n in (100, 1 << 22, 1 << 24, 1 << 40)] == [8, 8, 9, 11] and dedup.bands_for_count(1 << 50, 20) == 22


def test_embedding_batches_and_failures(spark):
    def load():
        def encode(values):
            if any(v is None or b"bad" in bytes(v) for v in values):
                raise ValueError("unreadable")
            return [[float(len(v)), 1.0] for v in values]

        return encode

    df = spark.createDataFrame([(i, float(i), b"bad" if i == 3 else b"x" * i) for i in range(1, 9)] + [(9, 0.0, None)], "image_id long, mtime double, content binary")
    got = embed.embed(df, load, batch=4)
    assert rows(got, "image_id") == [(i,) for i in range(1, 9) if i != 3]
    assert embed.query_vector(lambda: lambda texts: [[3.0, 4.0] for _ in texts], "q") == [0.6, 0.8]


def test_a_worker_loads_a_model_once(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda values: [[float(len(v))] for v in values]

    df = spark.createDataFrame([(i, 0.0, b"x" * i) for i in range(1, 41)], "image_id long, mtime double, content binary").repartition(20)
    assert embed.embed(df, load).count() == 40 and embed.embed(df, load).count() == 40
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) <= 8
    twice = embed.embed(df, lambda: lambda values: [[-1.0] for _ in values]).select("vector").distinct().collect()  # another model
    assert [r.vector for r in twice] == [[-1.0]]


def test_thumbnails_are_made_once(spark):
    asked = spark.createDataFrame([("/a", 1.0, 5), ("/b", 1.0, 5), ("/c", 1.0, 5)], "path string, mtime double, size long")
    have = spark.createDataFrame([("/a", 1.0, 5, "webp", b"a"), ("/b", 0.5, 5, "webp", b"old")], "path string, mtime double, size long, ext string, blob binary")
    every, new = thumbs.get_or_create(asked, have, lambda df: df.withColumn("blob", F.when(F.col("path") != "/c", F.encode("path", "utf-8"))))
    assert rows(new, "path") == [("/b",)] and rows(every, "path") == [("/a",), ("/b",)]
    assert stats.db_stats(spark.createDataFrame([], "size long"), spark.createDataFrame([], "is_canonical int"), spark.createDataFrame([], "cluster_id int")).first().total_size == 0


def test_names_pass_over_any_number_of_used_ones(spark):
    paths = ["/1/IMG.jpg", "/2/IMG.jpg", "/3/IMG.jpg", *[f"/0/IMG_{k}.jpg" for k in range(1, 101)], "/1/x", "/2/x"]
    taken = ["x", *[f"x_{k}" for k in range(1, 90) if k != 70], "IMG_102.jpg"]
    got = names.unique_names(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(t,) for t in taken], "name string"))
    told = {r.path: r.unique_name for r in got.collect()}
    assert told == {p: p[3:] for p in paths} | {"/2/IMG.jpg": "IMG_101.jpg", "/3/IMG.jpg": "IMG_103.jpg", "/1/x": "x_70", "/2/x": "x_90"}
