"""Groups of near-duplicates that are kept up: new hashes probe a stored index, and only groups that change are told anew.

The state has each image's hash with its component, named by one of the component's hashes, and the keys of every distinct
hash. What comes in is compared with hashes of equal keys, and the links it has join its hashes and the components they
reach, by contraction. What goes takes its hash along only if no other image has it; then the component's remaining
hashes, and no others, are linked anew, which may split it. An image whose hash has changed goes and comes in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.config import CONFIG
from framewell.functions.hashes import hamming, shared_band_keys
from framewell.operators.dedup import bands_for_count, hash_classes, hash_edges
from framewell.plans.components import connected_components
from framewell.plans.joins import skew_join, small
from framewell.session import materialise


@dataclass
class HashState:
    members: DataFrame  # (image_id, phash, rep)
    keys: DataFrame  # (bucket, phash)
    bands: int


def index_keys(known: DataFrame, radius: int, bands: int) -> DataFrame:
    """(bucket, phash): numbers of the keys that hashes within the radius share one of."""
    return known.select("phash", F.explode(shared_band_keys(F.col("phash"), radius, bands)).alias("k")).select(F.xxhash64("k.combination", "k.key").alias("bucket"), "phash")


def _labelled(known: DataFrame, radius: int) -> DataFrame:
    """(phash, rep) of distinct hashes, by their links with each other."""
    label = connected_components(hash_edges(known, radius)).select(F.col("node").alias("phash"), "component")
    return materialise(known.join(label, "phash", "left").select("phash", F.coalesce("component", "phash").alias("rep")), "labelled")


def begin(hashes: DataFrame, radius: int = CONFIG.hash_radius) -> HashState:
    """The state of a set of (image_id, phash)."""
    own = materialise(hashes.select("image_id", "phash"), "hashes")
    known = materialise(hash_classes(own).select("phash", "n"), "nodes")
    bands = bands_for_count(known.count(), radius)
    members = skew_join(own, known.join(_labelled(known.select("phash"), radius), "phash"), "phash", "n")
    return HashState(materialise(members.select("image_id", "phash", "rep"), "members"), materialise(index_keys(known, radius, bands), "keys"), bands)


def update(state: HashState, added: DataFrame, removed: DataFrame, radius: int = CONFIG.hash_radius) -> HashState:
    """The state after images went (image_id) and came in (image_id, phash); the same one if none did.

    It is what `begin` makes of the hashes that are there then, but for the names of components.
    """
    added, removed = materialise(added.select("image_id", "phash"), "added"), materialise(removed.select("image_id").distinct(), "removed")
    if added.isEmpty() and removed.isEmpty():
        return state
    kept, keys = state.members, state.keys
    if not removed.isEmpty():
        gone = kept.join(small(removed), "image_id", "left_semi").select("phash", "rep").distinct()
        kept = materialise(kept.join(small(removed), "image_id", "left_anti"), "members")
        lost = materialise(gone.join(kept.select("phash").distinct(), "phash", "left_anti"), "lost")
        if not lost.isEmpty():
            keys = materialise(keys.join(small(lost.select("phash")), "phash", "left_anti").select("bucket", "phash"), "keys")
            hit = materialise(lost.select("rep").distinct(), "hit")
            left = materialise(kept.join(small(hit), "rep", "left_semi").select("phash").distinct(), "left")
            anew = _labelled(left, radius).withColumnRenamed("rep", "_rep")
            kept = materialise(kept.join(small(anew), "phash", "left").select("image_id", "phash", F.coalesce("_rep", "rep").alias("rep")), "members")
    fresh = materialise(added.select("phash").distinct().join(kept.select("phash").distinct(), "phash", "left_anti"), "fresh")
    told = kept.join(small(added.select("phash").distinct()), "phash", "left_semi").select("phash", "rep").distinct()
    if not fresh.isEmpty():
        own = materialise(index_keys(fresh, radius, state.bands), "keys")
        near = own.join(keys.withColumnRenamed("phash", "other"), "bucket").filter(hamming(F.col("phash"), F.col("other")) <= radius).select("phash", "other").distinct()
        near = materialise(near, "near")
        reached = kept.join(small(materialise(near.select(F.col("other").alias("phash")).distinct(), "reached")), "phash", "left_semi").select(F.col("phash").alias("other"), "rep").distinct()
        links = near.join(reached, "other").select(F.col("phash").alias("src"), F.col("rep").alias("dst")).unionByName(hash_edges(fresh, radius))
        label = materialise(connected_components(links), "joined")
        kept = materialise(kept.join(small(label.toDF("rep", "_to")), "rep", "left").select("image_id", "phash", F.coalesce("_to", "rep").alias("rep")), "members")
        told = kept.join(small(added.select("phash").distinct()), "phash", "left_semi").select("phash", "rep").distinct()
        told = told.unionByName(fresh.join(label.toDF("phash", "_to"), "phash", "left").select("phash", F.coalesce("_to", "phash").alias("rep")))
        keys = keys.unionByName(own)
    new = added.join(small(materialise(told, "told")), "phash").select("image_id", "phash", "rep")
    return HashState(materialise(kept.unionByName(new), "members"), keys, state.bands)


def members_of_groups(state: HashState) -> DataFrame:
    """(group_id, image_id) of groups of two or more; a group's id is its smallest member's."""
    sizes = state.members.groupBy("rep").agg(F.min("image_id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return skew_join(state.members.select("image_id", "rep"), sizes, "rep", "n").select("group_id", "image_id")
