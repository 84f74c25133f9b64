"""Near-duplicates by 64-bit hashes: candidate pairs, groups, canonical members, and their reports."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.config import CONFIG, bands_for, min_shared_bands
from framewell.functions.hashes import band_values, further_masks, hamming, shared_band_keys
from framewell.operators.scan import first_per
from framewell.plans.cells import joined_in_cells, pairs_in_cells
from framewell.plans.components import connected_components
from framewell.plans.joins import skew_join, small
from framewell.plans.numbering import row_numbers
from framewell.session import materialise


def band_index(hashes: DataFrame, bands: int = 8) -> DataFrame:
    """(image_id, band, value): the inverted index of the bands."""
    return hashes.select("image_id", F.posexplode(band_values(F.col("phash"), bands)).alias("band", "value"))


def hash_classes(hashes: DataFrame) -> DataFrame:
    """(phash, image_id, n): each distinct hash with the smallest of its images and their number."""
    return hashes.groupBy("phash").agg(F.min("image_id").alias("image_id"), F.count("*").alias("n"))


def lsh_candidates(hashes: DataFrame, radius: int = CONFIG.hash_radius) -> DataFrame:
    """(a, b, shared): pairs, a < b, that share enough equal bands to lie within the radius.

    Such pairs are very many, as the square of the images; none is held or shuffled on its way out.
    """
    bands = bands_for(radius)
    rows = materialise(hashes.select(F.col("image_id").alias("id"), "phash"), "hashes")
    return pairs_in_cells(rows, 64, bands, max(2, min_shared_bands(radius, bands)), "shared")


#: Distinct hashes of a bucket on average and at most: keys get longer for the one, buckets are dealt again for the other.
BUCKET, FULL_BUCKET = 64, 2048
#: Keys of a hash at most.
MOST_KEYS = 500
#: Hashes that meet by keys of one band at most.
FEW = 1 << 22


def bands_for_count(n: int, radius: int) -> int:
    """Bands whose keys leave BUCKET of n evenly spread hashes in a bucket or so: more hashes, longer keys, more of them."""
    bands = bands_for(radius)
    while comb(bands + 1, radius) <= MOST_KEYS and n >> (64 // bands * (bands - radius)) > BUCKET:
        bands += 1
    return bands


def dealt_by_keys(known: DataFrame, radius: int, bands: int) -> DataFrame:
    """(bucket, phash): any two of the distinct hashes within the radius meet in a bucket of FULL_BUCKET or so at most.

    A bucket that is fuller is dealt again by keys of the bits that its own key leaves, and one that is still fuller is
    cut into parts that meet two by two. Buckets are numbers by hash: should two be one, some hashes meet in vain.
    """
    keys = shared_band_keys(F.col("phash"), radius, bands)
    keyed = materialise(known.select("phash", F.explode(keys).alias("k")).select("k.combination", "phash", F.xxhash64("k.combination", "k.key").alias("bucket")), "keyed")

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        full = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > FULL_BUCKET), "full")
        told = rows.join(small(full), "bucket", "left")
        return told.filter("n is null").select("bucket", "phash"), told.filter("n is not null")

    cold, hot = split(keyed)
    if hot.isEmpty():
        return cold
    more = [(c, k, m) for c, masks in enumerate(further_masks(radius, bands)) for k, m in enumerate(masks)]  # as many as keys, squared
    more = known.sparkSession.createDataFrame(more, "combination int, k int, mask long")
    again = hot.join(F.broadcast(more), "combination").select(F.xxhash64("bucket", "k", F.col("phash").bitwiseAND(F.col("mask"))).alias("bucket"), "phash")
    warm, still = split(materialise(again, "keyed"))
    parts = F.ceil(F.col("n") / (FULL_BUCKET // 2)).cast("long")
    own = F.pmod(F.xxhash64("phash"), parts)
    other = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other")
    met = still.select("bucket", "phash", own.alias("own"), other).select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "phash")
    return cold.unionByName(warm).unionByName(met)


def _bands(n: int, radius: int) -> int:
    """Bands for n hashes: keys of one band, the fewest rows, until FEW of them fill buckets too far."""
    return radius + 1 if n <= FEW else bands_for_count(n, radius)


def class_links(hashes: DataFrame, radius: int = CONFIG.hash_radius) -> DataFrame:
    """(a, b, distance), a < b: links between distinct hashes within the radius, told by the smallest image of each.

    With `hash_classes` these are all links: images of equal hashes are one class, and their pairs need not be listed.
    """
    known = materialise(hash_classes(hashes).select(F.col("image_id").alias("id"), "phash"), "classes")
    bands = _bands(known.count(), radius)
    return pairs_in_cells(known, radius, bands, bands - radius, "distance")


def near_pairs(hashes: DataFrame, radius: int = CONFIG.hash_radius, bands: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs of images, a < b, within the radius.

    Pairs leave the cells in which images meet as they are found, and are neither shuffled nor told apart afterwards;
    where a third of all images are equal, ask for `hash_classes` and `class_links` instead.
    """
    rows = materialise(hashes.select(F.col("image_id").alias("id"), "phash"), "hashes")
    bands = bands or _bands(rows.count(), radius)
    return pairs_in_cells(rows, radius, bands, bands - radius, "distance")


def hash_edges(known: DataFrame, radius: int = CONFIG.hash_radius) -> DataFrame:
    """(src, dst): links within the radius that connect the distinct hashes as all such links do."""
    bands = _bands(known.count(), radius)
    return joined_in_cells(known.select("phash"), radius, bands, bands - radius).distinct()


def components(hashes: DataFrame, radius: int = CONFIG.hash_radius) -> DataFrame:
    """(image_id, component) of every image: the smallest id reachable over hashes within the radius of each other.

    Equal hashes are one node. In each bucket only the links that connect it leave the task, never its pairs, and rows of
    a hash that very many images have stay where they are when they are told their component.
    """
    own = materialise(hashes.select("image_id", "phash"), "hashes")
    known = materialise(hash_classes(own), "nodes")
    label = connected_components(hash_edges(known, radius)).select(F.col("node").alias("phash"), F.col("component").alias("rep"))
    told = materialise(known.join(label, "phash", "left").select("phash", "image_id", "n", F.coalesce("rep", "phash").alias("rep")), "told")
    least = told.groupBy("rep").agg(F.min("image_id").alias("component"), F.count("*").alias("classes"))
    of_hash = skew_join(told.select("phash", "n", "rep"), least, "rep", "classes").select("phash", "n", "component")
    return skew_join(own, of_hash, "phash", "n").select("image_id", "component")


def group_members(hashes: DataFrame, radius: int = CONFIG.hash_radius) -> DataFrame:
    """(group_id, image_id) of groups of two or more; a group's id is its smallest member's."""
    found = materialise(components(hashes, radius), "components")
    large = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return found.join(large, "component", "left_semi").select(F.col("component").alias("group_id"), "image_id")


def canonical_order() -> list:
    """Larger area first (0 where a dimension is not known), then earlier, then by path."""
    return [F.desc(F.coalesce(F.col("width") * F.col("height"), F.lit(0))), F.coalesce("mtime", F.lit(0.0)), "path"]


def with_canonical(members: DataFrame, images: DataFrame) -> DataFrame:
    """(group_id, image_id, is_canonical) with one canonical member a group.

    The smallest of each group's order is taken by an aggregate that combines before the shuffle, so no task sorts a
    group with a third of all rows.
    """
    rows = materialise(members.join(images, "image_id").select("group_id", "image_id", F.coalesce(F.col("width") * F.col("height"), F.lit(0)).alias("area"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"), "path"), "members")
    best = rows.groupBy("group_id").agg(F.min(F.struct(-F.col("area"), F.col("mtime"), F.col("path"), F.col("image_id"))).alias("b")).select("group_id", F.col("b.image_id").alias("best"))
    return rows.join(best, "group_id").select("group_id", "image_id", (F.col("image_id") == F.col("best")).cast("int").alias("is_canonical"))


def dedup_groups(hashes: DataFrame, images: DataFrame, radius: int = CONFIG.hash_radius) -> DataFrame:
    return with_canonical(group_members(hashes, radius), images)


def merge_groups(old: DataFrame, new: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """(group_id, image_id, is_canonical): the new groups first, then the old ones that share no image with any of them.

    canonical: image_ids told to be canonical; where given, other members get 0 but for groups of one, old ones
    included. Without it all members get 1.
    """
    hit = old.join(new.select("image_id").distinct(), "image_id", "left_semi").select("group_id").distinct()
    kept = old.join(hit, "group_id", "left_anti")
    both = new.select(F.lit(0).alias("age"), "group_id", "image_id").unionByName(kept.select(F.lit(1).alias("age"), "group_id", "image_id"))
    numbered = row_numbers(both.groupBy("age", "group_id").agg(F.count("*").alias("n")), ["age", "group_id"])
    rows = both.join(numbered, ["age", "group_id"])
    if canonical is None:
        return rows.select(F.col("number").alias("group_id"), "image_id", F.lit(1).alias("is_canonical"))
    told = canonical.select("image_id", F.lit(True).alias("_told")).distinct()
    flag = F.when(F.col("_told").isNotNull() | (F.col("n") == 1), 1).otherwise(0)
    return rows.join(told, "image_id", "left").select(F.col("number").alias("group_id"), "image_id", flag.alias("is_canonical"))


def merge_groups_keeping_flags(old: DataFrame, new: DataFrame) -> DataFrame:
    """As merge_groups, but kept groups keep their own canonical members."""
    canonical = new.filter("is_canonical = 1").select("image_id").union(old.filter("is_canonical = 1").select("image_id"))
    return merge_groups(old, new, canonical)


def duplicates(groups: DataFrame) -> DataFrame:
    return groups.filter("is_canonical = 0")


def duplicate_bytes(groups: DataFrame, images: DataFrame) -> DataFrame:
    return duplicates(groups).join(images, "image_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def _share(part, total):
    return F.when(total == 0, F.lit(0)).otherwise(F.floor(part * 100 / total)).cast("long")


def dedup_report(groups: DataFrame, images: DataFrame) -> DataFrame:
    """One row: total, similar, unique, their whole percentages, groups, extras (members beyond one a group)."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("similar"), F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extras"))
    both = images.agg(F.count("*").alias("total")).join(F.broadcast(found), F.lit(True))
    unique = F.col("total") - F.col("similar")
    return both.select("total", "similar", unique.alias("unique_files"), _share(F.col("similar"), F.col("total")).alias("similar_pct"), _share(unique, F.col("total")).alias("unique_pct"), "groups", "extras")


def top_groups(groups: DataFrame, n: int = 10, members: int = 5) -> DataFrame:
    """(group_id, n, canonical, members) of the largest groups, with their first members by id."""
    large = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("is_canonical") == 1, F.col("image_id"))).alias("canonical")).orderBy(F.desc("n"), "group_id").limit(n)
    some = groups.join(F.broadcast(large.select("group_id")), "group_id", "left_semi")
    first = some.withColumn("_r", F.row_number().over(Window.partitionBy("group_id").orderBy("image_id"))).filter(F.col("_r") <= members)
    listed = first.groupBy("group_id").agg(F.array_sort(F.collect_list("image_id")).alias("members"))
    return large.join(listed, "group_id")


def failure_reasons(failed: DataFrame) -> DataFrame:
    return failed.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def dedup_summary(groups: DataFrame, images: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: total, similar (with canonical), duplicates, failed, remaining, share that could go in whole per cent."""
    g = groups.agg(F.count("*").alias("similar"), F.coalesce(F.sum(F.when(F.col("is_canonical") == 0, 1).otherwise(0)), F.lit(0)).alias("duplicates"))
    f = failed.agg(F.count("*").alias("failed"))
    both = images.agg(F.count("*").alias("total")).join(F.broadcast(g), F.lit(True)).join(F.broadcast(f), F.lit(True))
    return both.select("total", "similar", "duplicates", "failed", (F.col("total") - F.col("similar") - F.col("failed")).alias("remaining"), _share(F.col("duplicates"), F.col("total")).alias("deletable_pct"))


def hash_search(hashes: DataFrame, query: int, radius: int = CONFIG.hash_radius, top: int | None = CONFIG.search_top) -> DataFrame:
    """(image_id, distance, rank) within the radius of one hash, nearest first, ties by id.

    One pass over the hashes with a bit count beats probing buckets here: every row is read in either way.
    """
    near = hashes.select("image_id", hamming(F.col("phash"), F.lit(query).cast("long")).alias("distance")).filter(F.col("distance") <= radius)
    order = ["distance", "image_id"]
    near = near.orderBy(*order).limit(top) if top else near
    return near.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hash_search_by_index(index: DataFrame, hashes: DataFrame, query: int, radius: int = CONFIG.hash_radius) -> DataFrame:
    """The same from a stored band index: candidates share one band, which is sure for radii below the bands' number."""
    probe = hashes.sparkSession.range(1).select(F.posexplode(band_values(F.lit(query).cast("long"))).alias("band", "value"))
    some = index.join(F.broadcast(probe), ["band", "value"], "left_semi").select("image_id").distinct()
    near = hashes.join(some, "image_id", "left_semi").select("image_id", hamming(F.col("phash"), F.lit(query).cast("long")).alias("distance"))
    return near.filter(F.col("distance") <= radius)


def pending_dedup(images: DataFrame, hashes: DataFrame, failed: DataFrame) -> DataFrame:
    """One row (pending): whether an image has neither a hash nor failed."""
    left = images.join(hashes.select("image_id"), "image_id", "left_anti").join(failed.select("path"), "path", "left_anti")
    return left.limit(1).agg((F.count("*") > 0).alias("pending"))


def move_plan(groups: DataFrame, images: DataFrame, folder: str, taken: DataFrame | None = None) -> DataFrame:
    """(src, dst, size) for every duplicate, with names free of collisions in the folder, which holds those in `taken`."""
    from framewell.operators.names import unique_names

    rows = duplicates(groups).join(images, "image_id").select("path", "size")
    return unique_names(rows, taken).select(F.col("path").alias("src"), F.concat(F.lit(folder.rstrip("/") + "/"), F.col("unique_name")).alias("dst"), "size")


def incremental_groups(images: DataFrame, old_hashes: DataFrame, new_hashes: DataFrame, failed: DataFrame, radius: int = CONFIG.hash_radius) -> DataFrame:
    """Groups after a scan: the latest hash of every image still there, compared with each other.

    New images are so compared with old duplicates too, and changed ones only by their new hash.
    """
    rows = old_hashes.withColumn("_age", F.lit(1)).unionByName(new_hashes.withColumn("_age", F.lit(0)))
    latest = first_per(rows, ["image_id"], ["_age"]).drop("_age")
    there = images.join(failed.select("path"), "path", "left_anti").select("image_id")
    return dedup_groups(latest.join(there, "image_id", "left_semi"), images, radius)
