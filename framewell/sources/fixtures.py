"""The catalog's tables derived from the driver's: documents stand for images, their tokens' simhash for the picture's.

Select lists are text that Spark and DuckDB both run, so the queries and their SQL see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.functions.hashes import token_simhash
from framewell.sources.tables import read_table

_EXT = "CASE doc_id % 7 WHEN 0 THEN 'jpg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' WHEN 4 THEN 'bmp' WHEN 5 THEN 'gif' ELSE 'tiff' END"
PATH = f"concat('/', source, '/', lang, '/doc', cast(doc_id as string), '.', {_EXT})"
IMAGES = [
    ("image_id", "doc_id"), ("path", PATH), ("size", "n_chars"), ("ext", _EXT),
    ("mtime", "cast(1700000000 + (doc_id * 7919) % 100000 as double)"), ("source", "concat('/', source)"),
    ("width", "CASE WHEN doc_id % 11 = 0 THEN 0 ELSE cast(200 + (doc_id * 31) % 400 as int) END"),
    ("height", "CASE WHEN doc_id % 11 = 0 THEN 0 ELSE cast(150 + (doc_id * 17) % 300 as int) END"),
]
OLD = [
    ("image_id", "image_id"), ("path", "path"), ("size", "CASE WHEN image_id % 7 = 0 THEN size + 1 ELSE size END"), ("ext", "ext"),
    ("mtime", "CASE WHEN image_id % 13 = 0 THEN mtime + 5 ELSE mtime END"), ("source", "source"), ("width", "width"), ("height", "height"),
]
GONE = [(n, {"image_id": "image_id + 1000000", "path": "concat('/gone', path)"}.get(n, n)) for n, _ in OLD]
CLUSTERS = [
    ("image_id", "vec_id"), ("cluster_id", "CASE label WHEN 9 THEN -2 WHEN 8 THEN -1 ELSE label END"),
    ("name", "CASE label WHEN 9 THEN 'garbage' WHEN 3 THEN 'three' ELSE '' END"),
]
SAVED = [("image_id", "image_id"), ("phash", "image_id * 7919"), ("mtime", "CASE WHEN image_id % 7 = 0 THEN mtime - 1 ELSE mtime END")]
EMBEDDINGS_MTIME = "CASE WHEN image_id % 9 = 0 THEN mtime - 7 ELSE mtime END"
THUMBS_MTIME = "CASE WHEN image_id % 9 = 0 THEN mtime + 1 ELSE mtime END"


def listed(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns)


def _select(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read_table(spark, sf_dir, "documents"), IMAGES)


def old_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier snapshot: some rows not yet there, some with other sizes or times, some since removed."""
    now = images(spark, sf_dir)
    return _select(now.filter("image_id % 10 <> 0"), OLD).unionByName(_select(now.filter("image_id % 20 = 0"), GONE))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_simhash(docs, "doc_id", "text").select(F.col("id").alias("image_id"), "phash")


def saved_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run stored: every fifth image not yet hashed, every seventh hashed before it changed."""
    now = images(spark, sf_dir).filter("image_id % 5 <> 0")
    return _select(now, SAVED)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vector"), "label")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = vectors(spark, sf_dir).join(images(spark, sf_dir), "image_id")
    return joined.select("image_id", "vector", F.expr(EMBEDDINGS_MTIME).alias("mtime"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read_table(spark, sf_dir, "embeddings"), CLUSTERS)


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = read_table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    reason = "CASE WHEN image_id % 2 = 0 THEN 'corrupt' ELSE 'not_found' END"
    return images(spark, sf_dir).join(toxic.withColumnRenamed("doc_id", "image_id"), "image_id", "left_semi").select("path", F.expr(reason).alias("reason"))


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_table(spark, sf_dir, "labels").filter("quality = 1 and doc_id % 3 = 0").select(F.col("doc_id").alias("image_id"))
    return images(spark, sf_dir).join(good, "image_id", "left_semi").select("path", F.lit("global").alias("scope"))


def thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = images(spark, sf_dir).filter("image_id % 4 <> 0")
    return made.select("path", F.expr(THUMBS_MTIME).alias("mtime"), "size", F.lit("webp").alias("ext"))


# The same as DuckDB's common table expressions.
_TOKENS = "SELECT doc_id, ('0x' || substr(md5(tok), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n\\r\\t]+')) AS tok FROM documents) WHERE tok <> ''"
_BITS = " + ".join(f"(CASE WHEN 2 * sum(((h >> {b}) & 1)::BIGINT) > count(*) THEN {'(-9223372036854775807 - 1)' if b == 63 else 1 << b}::BIGINT ELSE 0::BIGINT END)" for b in range(64))
SQL = {
    "images_v": f"SELECT {listed(IMAGES)} FROM documents",
    "old_images_v": f"SELECT {listed(OLD)} FROM images_v WHERE image_id % 10 <> 0 UNION ALL SELECT {listed(GONE)} FROM images_v WHERE image_id % 20 = 0",
    "hashes_v": f"SELECT doc_id AS image_id, {_BITS} AS phash FROM ({_TOKENS}) GROUP BY doc_id",
    "saved_v": f"SELECT {listed(SAVED)} FROM images_v WHERE image_id % 5 <> 0",
    "vectors_v": "SELECT vec_id AS image_id, embedding::DOUBLE[] AS vector, label FROM embeddings",
    "embeddings_v": f"SELECT image_id, vector, {EMBEDDINGS_MTIME} AS mtime FROM vectors_v JOIN images_v USING (image_id)",
    "clusters_v": f"SELECT {listed(CLUSTERS)} FROM embeddings",
    "failed_v": "SELECT path, CASE WHEN image_id % 2 = 0 THEN 'corrupt' ELSE 'not_found' END AS reason FROM images_v WHERE image_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "selected_v": "SELECT path, 'global' AS scope FROM images_v WHERE image_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 3 = 0)",
    "thumbs_v": f"SELECT path, {THUMBS_MTIME} AS mtime, size, 'webp' AS ext FROM images_v WHERE image_id % 4 <> 0",
    "near_v": "SELECT a.phash AS x, b.phash AS y FROM (SELECT DISTINCT phash FROM hashes_v) a, (SELECT DISTINCT phash FROM hashes_v) b WHERE bit_count(xor(a.phash, b.phash)) <= 6",
    "reach_v": "SELECT x, y FROM near_v UNION SELECT r.x, n.y FROM reach_v r JOIN near_v n ON r.y = n.x",
    "component_v": "SELECT h.image_id, c.component FROM hashes_v h JOIN (SELECT r.x, min(g.image_id) AS component FROM reach_v r JOIN hashes_v g ON g.phash = r.y GROUP BY r.x) c ON c.x = h.phash",
    "members_v": "SELECT image_id, component AS group_id FROM component_v WHERE component IN (SELECT component FROM component_v GROUP BY 1 HAVING count(*) > 1)",
    "groups_v": "SELECT group_id, image_id, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY width * height DESC, mtime, path) = 1 THEN 1 ELSE 0 END AS is_canonical FROM members_v JOIN images_v USING (image_id)",
}
_NEEDS = {
    "saved_v": ["images_v"],
    "old_images_v": ["images_v"], "embeddings_v": ["vectors_v", "images_v"], "failed_v": ["images_v"], "selected_v": ["images_v"], "thumbs_v": ["images_v"],
    "near_v": ["hashes_v"], "reach_v": ["near_v"], "component_v": ["hashes_v", "reach_v"], "members_v": ["component_v"], "groups_v": ["members_v", "images_v"],
}


def with_views(query: str, *names: str, more: dict[str, str] | None = None) -> str:
    """The query behind the views it names, each after those it needs; `more` are its own, in order (`name AS MATERIALIZED` for one that is)."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS ({SQL[n]})" if n == "reach_v" else f"{n} AS MATERIALIZED ({SQL[n]})" for n in order]
    parts += [f"{n if ' AS ' in n else n + ' AS'} ({q})" for n, q in (more or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {query}" if parts else query
