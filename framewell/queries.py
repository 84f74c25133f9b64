"""One query for each operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.config import EXCLUDED_DIRS
from framewell.functions.hashes import unsigned
from framewell.functions.paths import format_size, in_excluded_dir
from framewell.functions.vectors import l2_normalised
from framewell.operators import cluster, dedup, display, layout, names, neighbours, scan, search, selection, stats, thumbs
from framewell.schema import conform
from framewell.sources import fixtures as fx
from framewell.sources.tables import read_table
from framewell.streaming.ingest import counts_by_window

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str, **more: str):
    """Registers a function under its name; the SQL runs behind the fixture views it names and its own."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = fx.with_views(sql, *views, more=more)
        return f

    return register


def groups(spark, sf) -> DataFrame:
    return dedup.dedup_groups(fx.hashes(spark, sf), fx.images(spark, sf))


def paths_of(rows: DataFrame, images: DataFrame) -> DataFrame:
    return rows.join(images.select("image_id", "path"), "image_id").select("path")


# scan

_EXT_SQL = "lower(list_last(string_split(path, '.')))"


@query(f"SELECT path, {_EXT_SQL} AS ext, size FROM images_v WHERE size >= 200 AND {_EXT_SQL} IN ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'gif', 'tiff')", "images_v")
def scan_filter(spark, sf):
    return scan.select_files(fx.images(spark, sf), min_size=200).select("path", "ext", "size")


_DIRS_SQL = ", ".join("'" + d.lower() + "'" for d in (*EXCLUDED_DIRS, "FR", "de"))


@query(f"SELECT url FROM (SELECT url, string_split(lower(regexp_replace(url, '^[a-z]+://[^/]*/', '')), '/') AS p FROM pages) WHERE NOT list_has_any(p[1:len(p) - 1], [{_DIRS_SQL}])")
def scan_exclude_dirs(spark, sf):
    relative = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    return read_table(spark, sf, "pages").filter(~in_excluded_dir(relative, ["FR", "de"])).select("url")


@query("SELECT ext, count(*) AS n, sum(size)::BIGINT AS bytes FROM images_v GROUP BY ext", "images_v")
def scan_report_by_ext(spark, sf):
    return scan.report_by_extension(fx.images(spark, sf))


@query("SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM images_v WHERE size >= 200", "images_v")
def scan_totals(spark, sf):
    return scan.scan_totals(scan.select_files(fx.images(spark, sf), min_size=200))


@query("SELECT source, count(*) AS n FROM images_v GROUP BY ROLLUP (source)", "images_v")
def count_by_root(spark, sf):
    return scan.count_by_root(fx.images(spark, sf))


_STATUS = "CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN n.size <> o.size OR n.mtime <> o.mtime THEN 'changed' ELSE 'unchanged' END"


@query(f"SELECT coalesce(n.path, o.path) AS path, {_STATUS} AS status FROM images_v n FULL JOIN old_images_v o ON n.path = o.path", "images_v", "old_images_v")
def snapshot_diff(spark, sf):
    return scan.snapshot_diff(fx.images(spark, sf), fx.old_images(spark, sf))


@query(
    "SELECT coalesce(o.image_id, n.image_id) AS image_id, n.path, n.size, n.ext, n.mtime, n.source, coalesce(o.width, n.width) AS width, coalesce(o.height, n.height) AS height "
    "FROM images_v n LEFT JOIN old_images_v o ON n.path = o.path UNION ALL SELECT o.* FROM old_images_v o LEFT JOIN images_v n ON n.path = o.path WHERE n.path IS NULL AND o.source <> '/src0'",
    "images_v", "old_images_v",
)
def snapshot_merge(spark, sf):
    return scan.merge_snapshot(fx.images(spark, sf), fx.old_images(spark, sf), "/src0")


@query("SELECT image_id, size FROM old_images_v WHERE image_id IN (SELECT image_id FROM images_v)", "images_v", "old_images_v")
def cascade_delete(spark, sf):
    merged = scan.merge_snapshot(fx.images(spark, sf), fx.old_images(spark, sf))
    return scan.surviving(fx.old_images(spark, sf).select("image_id", "size"), merged)


@query(
    "SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY image_id, size, mtime) AS turn FROM (SELECT * FROM images_v UNION ALL SELECT * FROM old_images_v)) WHERE turn = 1",
    "images_v", "old_images_v",
)
def insert_or_ignore(spark, sf):
    return scan.first_per(fx.images(spark, sf).unionByName(fx.old_images(spark, sf)), ["path"], ["image_id", "size", "mtime"])


@query(
    "SELECT * FROM saved_v WHERE image_id % 3 <> 0 OR image_id NOT IN (SELECT image_id FROM hashes_v) UNION ALL SELECT h.image_id, h.phash, i.mtime FROM hashes_v h JOIN images_v i USING (image_id) WHERE h.image_id % 3 = 0",
    "saved_v", "hashes_v", "images_v",
)
def upsert_hashes(spark, sf):
    new = fx.hashes(spark, sf).filter("image_id % 3 = 0").join(fx.images(spark, sf).select("image_id", "mtime"), "image_id")
    return scan.upsert(fx.saved_hashes(spark, sf), new, ["image_id"])


@query(
    "SELECT * FROM failed_v WHERE path NOT IN (SELECT path FROM images_v WHERE image_id % 50 = 0) UNION ALL SELECT path, 'corrupt' AS reason FROM images_v WHERE image_id % 50 = 0",
    "failed_v", "images_v",
)
def upsert_failed(spark, sf):
    new = conform(fx.images(spark, sf).filter("image_id % 50 = 0").select("path"), "failed_files")
    return scan.upsert(fx.failed(spark, sf), new, ["path"])


_OUT = "SELECT i.path FROM groups_v g JOIN images_v i USING (image_id) WHERE g.is_canonical = 0 UNION SELECT path FROM failed_v"


def _stale_sql(saved: str) -> str:
    return f"SELECT i.image_id, i.path FROM images_v i LEFT JOIN {saved} s USING (image_id) WHERE i.path NOT IN ({_OUT}) AND (s.mtime IS NULL OR s.mtime <> i.mtime)"


@query(_stale_sql("saved_v"), "groups_v", "failed_v", "saved_v")
def stale_hashes(spark, sf):
    images = fx.images(spark, sf)
    gone = paths_of(dedup.duplicates(groups(spark, sf)), images)
    return scan.stale(images, fx.saved_hashes(spark, sf), gone, fx.failed(spark, sf)).select("image_id", "path")


@query(_stale_sql("embeddings_v"), "groups_v", "failed_v", "embeddings_v")
def stale_embeddings(spark, sf):
    images = fx.images(spark, sf)
    gone = paths_of(dedup.duplicates(groups(spark, sf)), images)
    return scan.stale(images, fx.embeddings(spark, sf), gone, fx.failed(spark, sf)).select("image_id", "path")


@query(_OUT, "groups_v", "failed_v")
def excluded_paths(spark, sf):
    gone = paths_of(dedup.duplicates(groups(spark, sf)), fx.images(spark, sf))
    return gone.union(fx.failed(spark, sf).select("path")).distinct()


_ROOTS = {
    "parts": "SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) AS lang FROM pages",
    "roots": "SELECT DISTINCT concat('/', host, '/', lang) AS root FROM parts UNION SELECT DISTINCT concat('/', host, '/') FROM parts WHERE host LIKE 'www%'",
    "normal": "SELECT root, CASE WHEN root LIKE '%/' THEN substr(root, 1, length(root) - 1) ELSE root END AS n FROM roots",
    "first": "SELECT min(root) AS root, n FROM normal GROUP BY n",
}


@query("SELECT a.root FROM first a WHERE NOT EXISTS (SELECT 1 FROM first b WHERE a.n <> b.n AND starts_with(a.n, concat(b.n, '/')))", **_ROOTS)
def dedupe_roots(spark, sf):
    host, lang = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]*)", 1)
    parts = read_table(spark, sf, "pages").select(host.alias("host"), lang.alias("lang"))
    roots = parts.select(F.concat(F.lit("/"), "host", F.lit("/"), "lang").alias("root")).union(parts.filter("host like 'www%'").select(F.concat(F.lit("/"), "host", F.lit("/"))))
    return scan.without_nested_roots(roots.distinct())


# hashes and duplicates


@query("SELECT image_id, phash FROM hashes_v", "hashes_v")
def simhash64(spark, sf):
    return fx.hashes(spark, sf)


@query("SELECT image_id, CASE WHEN phash < 0 THEN (phash::HUGEINT + 18446744073709551616)::VARCHAR ELSE phash::VARCHAR END AS shown FROM hashes_v", "hashes_v")
def unsigned_hash(spark, sf):
    return fx.hashes(spark, sf).select("image_id", unsigned(F.col("phash")).cast("string").alias("shown"))


_BAND = "((phash >> (56 - 8 * band)) & 255)"
_INDEX = f"SELECT image_id, band::INT AS band, {_BAND}::BIGINT AS value FROM hashes_v, (SELECT unnest(range(8)) AS band)"


@query(_INDEX, "hashes_v")
def band_values(spark, sf):
    return dedup.band_index(fx.hashes(spark, sf))


@query("SELECT a.image_id AS a, b.image_id AS b, count(*) AS shared FROM idx a JOIN idx b ON a.band = b.band AND a.value = b.value AND a.image_id < b.image_id GROUP BY 1, 2 HAVING count(*) >= 2", "hashes_v", idx=_INDEX)
def lsh_candidates(spark, sf):
    return dedup.lsh_candidates(fx.hashes(spark, sf))


@query("SELECT a.image_id AS a, b.image_id AS b, bit_count(xor(a.phash, b.phash))::INT AS distance FROM hashes_v a JOIN hashes_v b ON a.image_id < b.image_id AND bit_count(xor(a.phash, b.phash)) <= 6", "hashes_v")
def hamming_pairs(spark, sf):
    return dedup.near_pairs(fx.hashes(spark, sf))


@query(
    "SELECT least(a.image_id, b.image_id) AS a, greatest(a.image_id, b.image_id) AS b, bit_count(xor(a.phash, b.phash))::INT AS distance FROM classes a JOIN classes b ON a.phash < b.phash WHERE bit_count(xor(a.phash, b.phash)) <= 6",
    "hashes_v", classes="SELECT phash, min(image_id) AS image_id FROM hashes_v GROUP BY phash",
)
def hash_class_links(spark, sf):
    return dedup.class_links(fx.hashes(spark, sf))


@query("SELECT phash, min(image_id) AS image_id, count(*) AS n FROM hashes_v GROUP BY phash", "hashes_v")
def hash_classes(spark, sf):
    return dedup.hash_classes(fx.hashes(spark, sf))


@query("SELECT image_id, component FROM component_v", "component_v")
def dedup_components(spark, sf):
    return dedup.components(fx.hashes(spark, sf))


@query("SELECT group_id, image_id, is_canonical FROM groups_v", "groups_v")
def dedup_groups(spark, sf):
    return groups(spark, sf)


@query("SELECT group_id, path FROM groups_v JOIN images_v USING (image_id) WHERE is_canonical = 1", "groups_v")
def canonical_pick(spark, sf):
    images = fx.images(spark, sf)
    return groups(spark, sf).filter("is_canonical = 1").join(images, "image_id").select("group_id", "path")


@query("SELECT path FROM groups_v JOIN images_v USING (image_id) WHERE is_canonical = 0", "groups_v")
def duplicate_paths(spark, sf):
    return paths_of(dedup.duplicates(groups(spark, sf)), fx.images(spark, sf))


@query("SELECT coalesce(sum(size), 0)::BIGINT AS bytes FROM groups_v JOIN images_v USING (image_id) WHERE is_canonical = 0", "groups_v")
def duplicates_size(spark, sf):
    return dedup.duplicate_bytes(groups(spark, sf), fx.images(spark, sf))


_NEW_GROUPS = "SELECT group_id, image_id, is_canonical FROM groups_v WHERE group_id % 3 = 0 UNION ALL SELECT DISTINCT group_id, group_id + 500000, 0 FROM groups_v WHERE group_id % 3 = 0"
_MERGED = (
    "SELECT 0 AS age, group_id, image_id FROM fresh UNION ALL SELECT 1, group_id, image_id FROM groups_v "
    "WHERE group_id NOT IN (SELECT g.group_id FROM groups_v g JOIN fresh USING (image_id))"
)


@query(
    "SELECT (dense_rank() OVER (ORDER BY age, group_id) - 1)::BIGINT AS group_id, image_id, "
    "CASE WHEN image_id IN (SELECT image_id FROM fresh WHERE is_canonical = 1) OR count(*) OVER (PARTITION BY age, group_id) = 1 THEN 1 ELSE 0 END AS is_canonical FROM merged",
    "groups_v", fresh=_NEW_GROUPS, merged=_MERGED,
)
def merge_groups(spark, sf):
    old = groups(spark, sf)
    some = old.filter("group_id % 3 = 0")
    new = some.unionByName(some.select("group_id", (F.col("group_id") + 500000).alias("image_id"), F.lit(0).alias("is_canonical")).distinct())
    return dedup.merge_groups(old, new, new.filter("is_canonical = 1"))


_PCT = "CASE WHEN {t} = 0 THEN 0 ELSE ({x}) * 100 // {t} END::BIGINT"


@query(
    f"SELECT t AS total, s AS similar, t - s AS unique_files, {_PCT.format(x='s', t='t')} AS similar_pct, {_PCT.format(x='t - s', t='t')} AS unique_pct, g AS groups, e AS extras "
    "FROM (SELECT (SELECT count(*) FROM images_v) AS t, coalesce(sum(n), 0)::BIGINT AS s, count(*) AS g, coalesce(sum(n - 1), 0)::BIGINT AS e FROM (SELECT count(*) AS n FROM groups_v GROUP BY group_id))",
    "groups_v", "images_v",
)
def dedup_report(spark, sf):
    return dedup.dedup_report(groups(spark, sf), fx.images(spark, sf))


@query(
    "SELECT group_id, count(*) AS n, min(image_id) FILTER (is_canonical = 1) AS canonical, array_to_string(list_sort(list(image_id))[1:5], ',') AS members FROM groups_v GROUP BY group_id ORDER BY n DESC, group_id LIMIT 10",
    "groups_v",
)
def top_groups(spark, sf):
    return dedup.top_groups(groups(spark, sf)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("SELECT reason, count(*) AS n FROM failed_v GROUP BY reason", "failed_v")
def failure_reasons(spark, sf):
    return dedup.failure_reasons(fx.failed(spark, sf))


@query(
    f"SELECT t AS total, s AS similar, d AS duplicates, f AS failed, t - s - f AS remaining, {_PCT.format(x='d', t='t')} AS deletable_pct FROM "
    "(SELECT (SELECT count(*) FROM images_v) AS t, (SELECT count(*) FROM groups_v) AS s, (SELECT count(*) FROM groups_v WHERE is_canonical = 0) AS d, (SELECT count(*) FROM failed_v) AS f)",
    "groups_v", "images_v", "failed_v",
)
def dedup_summary(spark, sf):
    return dedup.dedup_summary(groups(spark, sf), fx.images(spark, sf), fx.failed(spark, sf))


@query(
    "SELECT image_id, distance, row_number() OVER (ORDER BY distance, image_id)::INT AS rank FROM "
    "(SELECT image_id, bit_count(xor(phash, (SELECT phash FROM hashes_v WHERE image_id = 5)))::INT AS distance FROM hashes_v) WHERE distance <= 18 ORDER BY rank LIMIT 500",
    "hashes_v",
)
def hash_radius_search(spark, sf):
    hashes = fx.hashes(spark, sf)
    return dedup.hash_search(hashes, hashes.filter("image_id = 5").first()["phash"], radius=18)


@query("SELECT image_id, bit_count(xor(phash, (SELECT phash FROM hashes_v WHERE image_id = 5)))::INT AS distance FROM hashes_v WHERE bit_count(xor(phash, (SELECT phash FROM hashes_v WHERE image_id = 5))) <= 6", "hashes_v")
def hash_index_search(spark, sf):
    hashes = fx.hashes(spark, sf)
    return dedup.hash_search_by_index(dedup.band_index(hashes), hashes, hashes.filter("image_id = 5").first()["phash"])


@query("SELECT count(*) > 0 AS pending FROM images_v WHERE image_id NOT IN (SELECT image_id FROM saved_v) AND path NOT IN (SELECT path FROM failed_v)", "images_v", "saved_v", "failed_v")
def pending_dedup(spark, sf):
    return dedup.pending_dedup(fx.images(spark, sf), fx.saved_hashes(spark, sf), fx.failed(spark, sf))


@query("SELECT path AS src, concat('/moved/', list_last(string_split(path, '/'))) AS dst, size FROM groups_v JOIN images_v USING (image_id) WHERE is_canonical = 0", "groups_v")
def move_plan(spark, sf):
    return dedup.move_plan(groups(spark, sf), fx.images(spark, sf), "/moved/")


# statistics


@query(
    "SELECT (SELECT count(*) FROM images_v) AS total, (SELECT count(*) FROM groups_v WHERE is_canonical = 0) AS duplicates, "
    "(SELECT count(*) FROM images_v) - (SELECT count(*) FROM groups_v WHERE is_canonical = 0) AS unique_files, (SELECT count(DISTINCT cluster_id) FROM clusters_v WHERE cluster_id > 0) AS clusters, "
    "(SELECT count(*) FROM clusters_v WHERE cluster_id = -2) AS garbage, (SELECT sum(size)::BIGINT FROM images_v) AS total_size",
    "groups_v", "images_v", "clusters_v",
)
def db_stats(spark, sf):
    return stats.db_stats(fx.images(spark, sf), groups(spark, sf), fx.clusters(spark, sf))


@query("SELECT count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM selected_v JOIN images_v USING (path) WHERE scope = 'global'", "selected_v", "images_v")
def selected_stats(spark, sf):
    return stats.selected_stats(fx.selected(spark, sf), fx.images(spark, sf))


_MEGA = "SELECT cluster_id, count(*) AS n FROM clusters_v WHERE cluster_id > 0 GROUP BY cluster_id HAVING count(*) > {} * (SELECT count(*) FROM clusters_v)"


@query(_MEGA.format(0.07), "clusters_v")
def mega_clusters(spark, sf):
    return stats.mega_clusters(fx.clusters(spark, sf), 0.07)


@query(_MEGA.format("0.10"), "clusters_v")
def mega_clusters_tenth(spark, sf):
    return stats.mega_clusters(fx.clusters(spark, sf), 0.10)


@query("SELECT cluster_id, count(*) AS n FROM clusters_v GROUP BY 1", "clusters_v")
def label_histogram(spark, sf):
    return stats.label_histogram(fx.clusters(spark, sf))


@query("SELECT count(*) FILTER (cluster_id = -1) / count(*) AS noise_share FROM clusters_v", "clusters_v")
def noise_share(spark, sf):
    return stats.noise_share(fx.clusters(spark, sf))


@query(
    "SELECT count(*) AS n, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS clusters, round(count(*) FILTER (cluster_id = -1) * 100.0 / count(*), 1)::DOUBLE AS noise_pct, "
    "round(count(*) FILTER (cluster_id = -2) * 100.0 / count(*), 1)::DOUBLE AS garbage_pct, round(count(*) FILTER (cluster_id >= 0) / count(DISTINCT cluster_id) FILTER (cluster_id >= 0), 1)::DOUBLE AS mean_size FROM clusters_v",
    "clusters_v",
)
def cluster_report(spark, sf):
    return stats.cluster_report(fx.clusters(spark, sf))


_MEMBERS = "SELECT c.cluster_id, i.path FROM clusters_v c JOIN images_v i USING (image_id)"


@query(
    "SELECT t.cluster_id, t.n, array_to_string(list_sort(list(m.path))[1:10], ',') AS paths FROM (SELECT cluster_id, count(*) AS n FROM clusters_v WHERE cluster_id >= 0 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10) t JOIN members m USING (cluster_id) GROUP BY 1, 2",
    "clusters_v", "images_v", members=_MEMBERS,
)
def top_clusters(spark, sf):
    return display.top_clusters(fx.clusters(spark, sf), fx.images(spark, sf)).withColumn("paths", F.array_join("paths", ","))


# thumbnails

_FRESH = "FROM images_v i JOIN thumbs_v t ON i.path = t.path AND i.mtime = t.mtime AND i.size = t.size"
_MISSING = "FROM images_v i WHERE NOT EXISTS (SELECT 1 FROM thumbs_v t WHERE i.path = t.path AND i.mtime = t.mtime AND i.size = t.size)"


@query(f"SELECT image_id, path, mtime, size {_MISSING}", "images_v", "thumbs_v")
def missing_thumbnails(spark, sf):
    return thumbs.missing(fx.images(spark, sf), fx.thumbs(spark, sf))


@query(f"SELECT image_id, path, mtime, size {_MISSING} ORDER BY image_id LIMIT 20", "images_v", "thumbs_v")
def missing_thumbnails_first(spark, sf):
    return thumbs.missing(fx.images(spark, sf), fx.thumbs(spark, sf), 20)


@query(f"SELECT t.path, t.mtime, t.size, t.ext {_FRESH}", "images_v", "thumbs_v")
def fresh_thumbnails(spark, sf):
    return thumbs.fresh(fx.images(spark, sf), fx.thumbs(spark, sf)).select("path", "mtime", "size", "ext")


@query(f"SELECT count(*) AS n {_MISSING}", "images_v", "thumbs_v")
def count_missing(spark, sf):
    return thumbs.count_missing(fx.images(spark, sf), fx.thumbs(spark, sf))


# vectors

_CENTRE = {
    "centre0": "SELECT k, avg(x) AS x FROM (SELECT unnest(range(1, 65)) AS k, unnest(vector) AS x FROM vectors_v WHERE label = 0) GROUP BY k",
    "centre": "SELECT list(x / (SELECT sqrt(sum(x * x)) FROM centre0) ORDER BY k) AS q FROM centre0",
    "scores": "SELECT image_id, list_dot_product(vector, (SELECT q FROM centre)) / sqrt(list_dot_product(vector, vector)) AS score FROM vectors_v",
}


@query("SELECT e.image_id FROM embeddings_v e WHERE e.image_id NOT IN (SELECT image_id FROM groups_v WHERE is_canonical = 0)", "embeddings_v", "groups_v")
def embeddings_no_dups(spark, sf):
    rows = fx.embeddings(spark, sf).join(fx.images(spark, sf).select("image_id"), "image_id")
    return rows.join(dedup.duplicates(groups(spark, sf)).select("image_id"), "image_id", "left_anti").select("image_id")


@query(
    "SELECT image_id, unnest(range(64))::INT AS k, unnest(list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6))) AS x FROM (SELECT image_id, list_transform(vector, lambda y: y * (image_id + 2)) AS v FROM vectors_v)",
    "vectors_v",
)
def l2_normalize(spark, sf):
    grown = F.transform(F.col("vector").cast("array<double>"), lambda x: x * (F.col("image_id") + 2))
    rows = fx.vectors(spark, sf).select("image_id", F.posexplode(l2_normalised(grown)).alias("k", "x"))
    return rows.withColumn("x", F.round("x", 6))


def _query_vector(spark, sf) -> list[float]:
    return search.centroid(fx.vectors(spark, sf).filter("label = 0"))


@query("SELECT image_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, image_id)::INT AS rank FROM scores ORDER BY rank LIMIT 20", "vectors_v", **_CENTRE)
def cosine_topk(spark, sf):
    return search.cosine_top(fx.vectors(spark, sf), _query_vector(spark, sf), 20).withColumn("score", F.round("score", 6))


@query("SELECT image_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, image_id)::INT AS rank FROM scores WHERE score >= (SELECT max(score) FROM scores) - 0.15", "vectors_v", **_CENTRE)
def semantic_range_search(spark, sf):
    return search.semantic_search(fx.vectors(spark, sf), _query_vector(spark, sf), slack=0.15).withColumn("score", F.round("score", 6))


@query("SELECT s.image_id, s.rank, c.cluster_id FROM (SELECT image_id, row_number() OVER (ORDER BY score DESC, image_id)::INT AS rank FROM scores WHERE score >= (SELECT max(score) FROM scores) - 0.05) s LEFT JOIN clusters_v c USING (image_id)", "vectors_v", "clusters_v", **_CENTRE)
def search_with_clusters(spark, sf):
    found = search.semantic_search(fx.vectors(spark, sf), _query_vector(spark, sf))
    return search.with_clusters(found, fx.clusters(spark, sf)).select("image_id", "rank", "cluster_id")


_KNN = (
    "SELECT query_id, image_id, distance, rank FROM (SELECT q.image_id AS query_id, t.image_id AS image_id, list_distance(q.vector, t.vector) AS distance, "
    "row_number() OVER (PARTITION BY q.image_id ORDER BY list_distance(q.vector, t.vector), t.image_id)::INT AS rank FROM {q} q, {t} t) WHERE rank <= 5"
)
_ASKED = {"asked": "SELECT * FROM vectors_v WHERE image_id % 50 = 0", "train": "SELECT v.*, c.cluster_id FROM vectors_v v JOIN clusters_v c USING (image_id) WHERE cluster_id > 0"}
_VOTES = "SELECT query_id, cluster_id, count(*) AS votes FROM knn JOIN train USING (image_id) GROUP BY 1, 2"


def _asked(spark, sf):
    vectors, labels = fx.vectors(spark, sf), fx.clusters(spark, sf)
    train = vectors.join(labels.filter("cluster_id > 0").select("image_id"), "image_id", "left_semi")
    return vectors.filter("image_id % 50 = 0"), train, labels


@query("SELECT query_id, image_id, round(distance, 6) AS distance, rank FROM knn", "vectors_v", "clusters_v", **_ASKED, knn=_KNN.format(q="asked", t="train"))
def knn_join(spark, sf):
    asked, train, _ = _asked(spark, sf)
    return neighbours.knn_join(asked, train).withColumn("distance", F.round("distance", 6))


@query(
    "SELECT query_id, cluster_id, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, cluster_id) AS turn FROM votes) WHERE turn = 1",
    "vectors_v", "clusters_v", **_ASKED, knn=_KNN.format(q="asked", t="train"), votes=_VOTES,
)
def knn_vote(spark, sf):
    asked, train, labels = _asked(spark, sf)
    return neighbours.vote(neighbours.knn_join(asked, train), labels)


@query(
    "SELECT c.image_id, coalesce(w.cluster_id, c.cluster_id) AS cluster_id, c.name FROM clusters_v c LEFT JOIN (SELECT query_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, cluster_id) AS turn FROM votes) "
    "WHERE turn = 1 AND query_id IN (SELECT query_id FROM knn WHERE rank = 1 AND distance <= 1.15)) w ON w.query_id = c.image_id",
    "vectors_v", "clusters_v", asked="SELECT v.* FROM vectors_v v JOIN clusters_v c USING (image_id) WHERE cluster_id = -1", train=_ASKED["train"], knn=_KNN.format(q="asked", t="train"), votes=_VOTES,
)
def noise_rescue(spark, sf):
    return neighbours.noise_rescue(fx.vectors(spark, sf).select("image_id", "vector"), fx.clusters(spark, sf), farthest=1.15, share=0.01)


_ALL_KNN = {"knn": _KNN.format(q="vectors_v", t="vectors_v"), "core": "SELECT query_id AS image_id, max(distance) AS core FROM knn GROUP BY 1"}


@query("SELECT image_id, round(core, 6) AS core FROM core", "vectors_v", **_ALL_KNN)
def core_distance(spark, sf):
    return cluster.core_distances(fx.vectors(spark, sf), 5).withColumn("core", F.round("core", 6))


@query("SELECT k.query_id, k.image_id, round(greatest(k.distance, a.core, b.core), 6) AS reach FROM knn k JOIN core a ON a.image_id = k.query_id JOIN core b ON b.image_id = k.image_id", "vectors_v", **_ALL_KNN)
def mutual_reachability(spark, sf):
    vectors = fx.vectors(spark, sf)
    near = neighbours.knn_join(vectors, vectors, 5)
    cores = near.groupBy(F.col("query_id").alias("image_id")).agg(F.max("distance").alias("core"))
    return cluster.mutual_reachability(near, cores).select("query_id", "image_id", F.round("reach", 6).alias("reach"))


def _tree_sql(core_rank: int) -> dict[str, str]:
    """A spanning tree in SQL: pairs by (reach, a, b) have ranks, and rows are taken in one by one by the least of them."""
    return {
        "core": f"SELECT query_id AS image_id, max(distance) AS core FROM knn WHERE rank <= {core_rank} GROUP BY 1",
        "pair AS MATERIALIZED": "SELECT p.a, p.b, greatest(p.d, x.core, y.core) AS weight, row_number() OVER (ORDER BY greatest(p.d, x.core, y.core), a, b) AS r FROM "
        "(SELECT q.image_id AS a, t.image_id AS b, list_distance(q.vector, t.vector) AS d FROM vectors_v q JOIN vectors_v t ON q.image_id < t.image_id) p JOIN core x ON x.image_id = a JOIN core y ON y.image_id = b",
        "ranks AS MATERIALIZED": "SELECT a AS i, b AS j, r FROM pair UNION ALL SELECT b, a, r FROM pair",
        "prim": "SELECT 0::BIGINT AS step, j AS node, r AS best FROM ranks WHERE i = (SELECT min(image_id) FROM vectors_v) UNION ALL "
        "SELECT step + 1, node, least(best, r) FROM (SELECT *, arg_min(node, best) OVER () AS new FROM prim) p JOIN ranks ON i = new AND j = node WHERE node <> new",
        "tree AS MATERIALIZED": "SELECT pos, node, r, a, b, weight FROM (SELECT step + 1 AS pos, arg_min(node, best) AS node, min(best) AS r FROM prim GROUP BY step) JOIN pair USING (r)",
    }


# The rows in the order in which the tree took them in: components are runs without a longer edge, a merge is a place in
# the order with the run around it.
_HIERARCHY_SQL = {
    "place AS MATERIALIZED": "SELECT 0::BIGINT AS pos, min(image_id) AS node FROM vectors_v UNION ALL SELECT pos, node FROM tree",
    "highest AS MATERIALIZED": "SELECT f.pos AS i, t.pos AS j, max(t.r) OVER (PARTITION BY f.pos ORDER BY t.pos) AS r FROM place f JOIN tree t ON t.pos > f.pos",
    "step AS MATERIALIZED": "SELECT t.pos, t.r, 1 / greatest(t.weight, (SELECT min(weight) FROM tree WHERE weight > 0)) AS density, coalesce((SELECT max(x.pos) FROM tree x WHERE x.pos < t.pos AND x.r > t.r), 0) AS lo, "
    "coalesce((SELECT min(x.pos) FROM tree x WHERE x.pos > t.pos AND x.r > t.r), (SELECT count(*) FROM vectors_v)) AS hi FROM tree t",
    "bottom AS MATERIALIZED": "SELECT *, pos - lo >= 10 AS split FROM step WHERE hi - lo >= 10 AND (pos - lo >= 10) = (hi - pos >= 10)",
    "above AS MATERIALIZED": "SELECT c.pos AS cluster, arg_min(j.pos, j.r) AS parent FROM bottom c JOIN bottom j ON j.split AND j.r > c.r AND j.lo < c.pos AND c.pos < j.hi GROUP BY 1",
    "born AS MATERIALIZED": "SELECT c.pos AS cluster, c.r, c.split, j.pos AS parent, coalesce(j.density, 0) AS since, CASE WHEN j.pos IS NULL THEN 0 WHEN c.pos < j.pos THEN j.lo ELSE j.pos END AS lo, "
    "CASE WHEN j.pos IS NULL THEN (SELECT count(*) FROM vectors_v) WHEN c.pos < j.pos THEN j.pos ELSE j.hi END AS hi FROM bottom c LEFT JOIN above ON cluster = c.pos LEFT JOIN bottom j ON j.pos = parent",
    "mass AS MATERIALIZED": "SELECT b.cluster, any_value(b.parent) AS parent, any_value(b.split) AS split, sum(s.density - b.since) AS mass FROM born b JOIN place p ON p.pos >= b.lo AND p.pos < b.hi "
    "LEFT JOIN highest h ON h.i = least(p.pos, b.cluster) AND h.j = greatest(p.pos, b.cluster) JOIN step s ON s.r = greatest(b.r, coalesce(h.r, 0)) GROUP BY 1",
    "best": "SELECT 0::BIGINT AS turn, cluster, parent, mass AS best, 0.0::DOUBLE AS below FROM mass UNION ALL SELECT turn + 1, c.cluster, any_value(c.parent), CASE WHEN any_value(c.split) THEN greatest(any_value(c.mass), sum(CASE WHEN b.parent = c.cluster THEN b.best ELSE 0 END)) ELSE any_value(c.mass) END, "
    "sum(CASE WHEN b.parent = c.cluster THEN b.best ELSE 0 END) FROM best b JOIN mass c ON c.cluster = b.cluster OR c.cluster = b.parent WHERE turn < (SELECT count(*) FROM mass) GROUP BY turn, c.cluster",
    "good AS MATERIALIZED": "SELECT b.* FROM born b JOIN mass m USING (cluster) JOIN best t USING (cluster) WHERE turn = (SELECT max(turn) FROM best) AND m.parent IS NOT NULL AND (NOT m.split OR m.mass >= t.below)",
    "chosen AS MATERIALIZED": "SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM good o WHERE o.r > g.r AND o.lo <= g.lo AND g.hi <= o.hi)",
    "named AS MATERIALIZED": "SELECT cluster, row_number() OVER (ORDER BY min(node))::INT AS cluster_id FROM chosen JOIN place ON pos >= lo AND pos < hi GROUP BY cluster",
}


@query("SELECT count(*) AS edges, round(sum(weight), 6) AS weight FROM tree", "vectors_v", knn=_ALL_KNN["knn"], **_tree_sql(5))
def mst_weight(spark, sf):
    vectors = fx.vectors(spark, sf).select("image_id", "vector")
    tree = cluster.spanning_tree(vectors, cluster.core_distances(vectors, 5))
    return tree.agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


@query(
    "SELECT p.node AS image_id, coalesce(n.cluster_id, -1)::INT AS cluster_id FROM place p LEFT JOIN chosen c ON p.pos >= c.lo AND p.pos < c.hi LEFT JOIN named n USING (cluster)",
    "vectors_v", knn=_ALL_KNN["knn"], **_tree_sql(2), **_HIERARCHY_SQL,
)
def hdbscan_labels(spark, sf):
    return cluster.density_labels(fx.vectors(spark, sf).select("image_id", "vector"), 10)


@query()
def pca_reduce(spark, sf):
    return cluster.reduced(fx.vectors(spark, sf))


@query()
def learned_layout(spark, sf):
    return layout.learned_layout(fx.vectors(spark, sf))


@query()
def kmeans_fallback(spark, sf):
    return cluster.kmeans_labels(fx.vectors(spark, sf).select("image_id", "vector"))


@query()
def cluster_images(spark, sf):
    return cluster.cluster(fx.vectors(spark, sf).select("image_id", "vector"))


# clusters on show


@query(
    "SELECT cluster_id, number::INT AS number, ((number - 1) % 3)::INT AS grid_column, ((number - 1) // 3)::BIGINT AS grid_row FROM (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS number FROM (SELECT DISTINCT cluster_id FROM clusters_v))",
    "clusters_v",
)
def cluster_display(spark, sf):
    return display.cluster_numbers(fx.clusters(spark, sf))


@query("SELECT cluster_id, coalesce(min(nullif(name, '')), '') AS name FROM clusters_v GROUP BY 1", "clusters_v")
def cluster_names(spark, sf):
    return display.cluster_names(fx.clusters(spark, sf))


@query("SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY path) AS place, path FROM members", "clusters_v", "images_v", members=_MEMBERS)
def cluster_members(spark, sf):
    return display.member_places(fx.clusters(spark, sf), fx.images(spark, sf))


@query("SELECT i.path, c.cluster_id FROM images_v i LEFT JOIN clusters_v c USING (image_id)", "clusters_v", "images_v")
def path_to_cluster(spark, sf):
    images = fx.images(spark, sf)
    return display.path_to_cluster(images.select("path"), fx.clusters(spark, sf), images)


@query(
    "SELECT * FROM clusters_v WHERE image_id NOT IN (SELECT image_id FROM images_v WHERE size < 500) UNION ALL SELECT image_id, -2, 'garbage' FROM images_v WHERE size < 500",
    "clusters_v", "images_v",
)
def garbage_mark(spark, sf):
    return display.mark_garbage(fx.clusters(spark, sf), fx.images(spark, sf).filter("size < 500"))


@query("SELECT path, min(cluster_id) AS cluster_id FROM members GROUP BY path", "clusters_v", "images_v", members=_MEMBERS)
def prewarm_order(spark, sf):
    return display.prewarm_order(fx.clusters(spark, sf), fx.images(spark, sf))


@query(
    "SELECT cluster_id, path, coalesce(lag(path) OVER w, last_value(path) OVER a) AS previous_path, coalesce(lead(path) OVER w, first_value(path) OVER a) AS next_path FROM members "
    "WINDOW w AS (PARTITION BY cluster_id ORDER BY path), a AS (PARTITION BY cluster_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "clusters_v", "images_v", members=_MEMBERS,
)
def preview_next(spark, sf):
    return display.with_neighbours(fx.clusters(spark, sf), fx.images(spark, sf))


@query("SELECT path, size FROM images_v ORDER BY path LIMIT 30 OFFSET 60", "images_v")
def page_slice(spark, sf):
    return display.page(fx.images(spark, sf).select("path", "size"), 60, 30)


# selection

_VIEW = "SELECT path FROM images_v WHERE image_id % 4 = 0"


def _view(spark, sf) -> DataFrame:
    return fx.images(spark, sf).filter("image_id % 4 = 0").select("path")


@query(f"(SELECT path FROM selected_v EXCEPT ({_VIEW})) UNION ALL ({_VIEW} EXCEPT SELECT path FROM selected_v)", "selected_v", "images_v")
def selection_toggle(spark, sf):
    return selection.toggle(fx.selected(spark, sf), _view(spark, sf))


@query(
    "SELECT source, count(*) AS n, count(s.path) AS chosen, count(s.path) > 0 AS has_selection, CASE WHEN count(s.path) = 0 THEN 'none' WHEN count(s.path) = count(*) THEN 'all' ELSE 'partial' END AS state FROM images_v i LEFT JOIN selected_v s USING (path) GROUP BY source",
    "selected_v", "images_v",
)
def selection_state(spark, sf):
    return selection.state_by_group(fx.images(spark, sf).select("source", "path"), fx.selected(spark, sf), "source")


@query(f"SELECT path FROM selected_v UNION ({_VIEW})", "selected_v", "images_v")
def select_all(spark, sf):
    return selection.select_all(fx.selected(spark, sf), _view(spark, sf))


@query(f"SELECT path FROM selected_v EXCEPT ({_VIEW})", "selected_v", "images_v")
def select_none(spark, sf):
    return selection.select_all(fx.selected(spark, sf), _view(spark, sf), False)


@query(f"SELECT path FROM selected_v UNION ({_VIEW})", "selected_v", "images_v")
def toggle_all(spark, sf):
    return selection.toggle_all(fx.selected(spark, sf), _view(spark, sf))


@query("SELECT path, scope FROM (SELECT path, 'global' AS scope FROM selected_v WHERE path NOT IN (SELECT path FROM images_v WHERE image_id % 4 = 0) UNION ALL SELECT path, 'export' FROM images_v WHERE image_id % 4 = 0)", "selected_v", "images_v")
def save_selection(spark, sf):
    return selection.save_scope(fx.selected(spark, sf), _view(spark, sf), "export")


@query("SELECT count(*) AS n FROM images_v WHERE image_id % 4 = 0 AND path IN (SELECT path FROM selected_v)", "selected_v", "images_v")
def view_selected(spark, sf):
    return selection.count_in_view(fx.selected(spark, sf), _view(spark, sf))


# names and sizes

_KINDS = "CASE WHEN v < 1024 THEN concat(v, ' B') WHEN v < 1048576 THEN printf('%.1f KB', v / 1024) WHEN v < 1073741824 THEN printf('%.1f MB', v / 1048576) ELSE printf('%.2f GB', v / 1073741824) END"


@query(f"SELECT doc_id, {_KINDS} AS shown FROM (SELECT doc_id, n_chars * (1 + doc_id * doc_id * (doc_id % 5)) AS v FROM documents)")
def format_sizes(spark, sf):
    value = F.col("n_chars") * (1 + F.col("doc_id") * F.col("doc_id") * (F.col("doc_id") % 5))
    return read_table(spark, sf, "documents").select("doc_id", format_size(value).alias("shown"))


_NAMED = "concat('/', source, '/', cast(doc_id as string), '/doc', cast(doc_id % 50 as string), CASE WHEN doc_id % 3 = 0 THEN '.jpg' WHEN doc_id % 3 = 1 THEN '.PNG' ELSE '' END)"


@query(
    "SELECT path, CASE WHEN k = 0 THEN name WHEN contains(name, '.') THEN concat(string_split(name, '.')[1], '_', k, '.', string_split(name, '.')[2]) ELSE concat(name, '_', k) END AS unique_name FROM "
    f"(SELECT path, name, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS k FROM (SELECT path, list_last(string_split(path, '/')) AS name FROM (SELECT {_NAMED} AS path FROM documents)))",
)
def unique_names(spark, sf):
    return names.unique_names(read_table(spark, sf, "documents").selectExpr(f"{_NAMED} AS path")).select("path", "unique_name")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_by_window(spark, sf):
    return counts_by_window(read_table(spark, sf, "events")).withColumn("value", F.round("value", 4))
