"""The verbs of the catalog as functions, and as a command: scan, run, dedup, embed, cluster, search, phash-search, thumbnails, report, stats, clear."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.config import CONFIG
from framewell.functions.paths import split_list
from framewell.functions.phash import hashed, with_reasons
from framewell.functions.thumbnail import thumbnails
from framewell.operators import cluster as clustering
from framewell.operators import dedup as duplicates
from framewell.operators import embed as embedding
from framewell.operators import incremental
from framewell.operators import search as searching
from framewell.operators import transfer
from framewell.operators.catalog import Catalog
from framewell.operators.scan import report_by_extension, stale, without_nested_roots
from framewell.operators.stats import cluster_report, db_stats
from framewell.session import materialise
from framewell.sources import files, rasters
from framewell.streaming import batches


def scan(catalog: Catalog, roots: list[str], extensions: list[str] | None = None, exclude: list[str] | None = None, min_size: int = CONFIG.min_size, full: bool = False) -> DataFrame:
    """Takes the files under the roots in, root by root; roots inside others are left out. Returns the diffs together."""
    spark, out = catalog.spark, None
    kept = [r["root"] for r in without_nested_roots(spark.createDataFrame([(r,) for r in roots], "root string")).collect()]
    found = {root: materialise(files.scan(spark, [root], extensions, exclude, min_size), "scan") for root in kept}
    if full:
        every = None
        for rows in found.values():
            every = rows if every is None else every.unionByName(rows)
        if every is not None:
            catalog.save_images(every)
        return (every if every is not None else spark.createDataFrame([], "path string")).select("path", F.lit("new").alias("status"))
    for root, rows in found.items():
        diff = materialise(catalog.update_images(rows, root.rstrip("/") or "/"), "diff")
        out = diff if out is None else out.unionByName(diff)
    return out if out is not None else spark.createDataFrame([], "path string, status string")


def regroup(catalog: Catalog, full: bool = False, radius: int = CONFIG.hash_radius) -> bool:
    """Brings the groups up to date with the hashes; returns whether anything had to be done.

    Nothing is read if images, hashes and failures have the versions they had at the last call. Else what has changed
    since then updates the stored components, or all is grouped anew: with `full`, for another radius, or the first time.
    """
    spark, behind = catalog.spark, ("images", "image_hashes", "failed_files")
    now = {"radius": radius, **{t: (catalog.versions(t) or [0])[-1] for t in behind}}
    was = {r["name"]: r["value"] for r in catalog.read("group_state").collect()}  # a few rows
    if not full and all(was.get(k) == v for k, v in now.items()):
        return False
    images = catalog.read("images")
    there = images.join(catalog.read("failed_files").select("path"), "path", "left_anti").select("image_id")
    hashes = materialise(catalog.read("image_hashes").join(there, "image_id", "left_semi").select("image_id", "phash"), "hashes")
    if full or was.get("radius") != radius:
        state = incremental.begin(hashes, radius)
    else:
        old = incremental.HashState(catalog.read("hash_members"), catalog.read("hash_keys"), was["bands"])
        added = hashes.join(old.members.select("image_id", "phash"), ["image_id", "phash"], "left_anti")
        removed = old.members.join(hashes, ["image_id", "phash"], "left_anti").select("image_id")
        state = incremental.update(old, added, removed, radius)
        if state is old:
            state = None
    if state is not None:
        # a call that breaks off from here on leaves no state to go on from
        catalog.replace("group_state", spark.createDataFrame([("radius", -1)], "name string, value long"))
        catalog.replace("hash_members", state.members)
        catalog.replace("hash_keys", state.keys)
        catalog.save_groups(materialise(duplicates.with_canonical(incremental.members_of_groups(state), images), "groups"), incremental=False)
        now["bands"] = state.bands
    else:
        now["bands"] = was["bands"]
        catalog.save_groups(materialise(duplicates.with_canonical(catalog.read("dedup_groups").select("group_id", "image_id"), images), "groups"), incremental=False)
    catalog.replace("group_state", spark.createDataFrame([*now.items()], "name string, value long"))
    return True


def dedup(catalog: Catalog, full: bool = False, radius: int = CONFIG.hash_radius, move_to: str | None = None, decoders: dict[str, Callable] | None = None) -> DataFrame:
    """Hashes what needs it, groups all hashes, keeps failures; returns the summary. With a folder, duplicates are moved there.

    decoders: by extension, for formats that the JVM can't read; images that failed for want of one are tried again.
    """
    images = catalog.read("images")
    none = catalog.spark.createDataFrame([], "path string")
    todo = images if full else stale(images, catalog.read("image_hashes"), none, none)
    todo = materialise(todo, "todo")
    if full or not todo.isEmpty():
        decoded = rasters.rasters(catalog.spark, todo, decoders)
        told = materialise(with_reasons(files.pictures(catalog.spark, todo.select("path", "source", "mtime")), hashed(decoded)).drop("content"), "hashed")
        good, bad = told.filter("reason is null"), told.filter("reason is not null")
        catalog.update_dimensions(good.select("path", "width", "height"))
        catalog.save_hashes(good.select("path", "phash", "mtime"), incremental=not full)
        if not full:
            catalog.delete("failed_files", told, ["path"])
        catalog.save_failed(bad.select("path", "reason"), incremental=not full)
    regroup(catalog, full, radius)
    failed, images = catalog.read("failed_files"), catalog.read("images")
    groups = catalog.read("dedup_groups")
    if move_to:
        transfer.totals(materialise(transfer.carried_out(materialise(duplicates.move_plan(groups, images, move_to, files.names_in(catalog.spark, move_to)), "plan"), move=True), "moved")).show()
    return duplicates.dedup_summary(groups, images, failed)


def embed(catalog: Catalog, load: Callable, full: bool = False, a_commit: int = 100_000, decoders: dict[str, Callable] | None = None) -> None:
    """Vectors of images that are neither duplicates nor failed; load() brings the model (contents to vectors).

    With decoders, {} where the JVM's are enough, the model gets decoded pictures that stand upright in place of files.

    They are computed in batches of about a_commit images, each of which leaves a part of the table, so a run that
    breaks off goes on where it was and nothing is written twice.
    """

    def work(batch: DataFrame) -> DataFrame:
        if decoders is None:
            return embedding.embed(files.pictures(batch.sparkSession, batch), load)
        batch = materialise(batch, "batch")
        read = rasters.rasters(batch.sparkSession, batch, decoders, turns=True)
        picture = F.struct("height", "width", "channels", "data", "orientation").alias("picture")
        return embedding.embed(batch.select("image_id", "mtime", "path").join(read.select("path", picture), "path"), load, "picture")

    if batches.pending(catalog, "embed"):
        batches.in_batches(catalog, "embed", "embeddings", work, a_batch=a_commit)
    images, groups = catalog.read("images"), catalog.read("dedup_groups")
    gone = duplicates.duplicates(groups).join(images, "image_id").select("path")
    saved = catalog.read("embeddings").limit(0) if full else catalog.read("embeddings")
    todo = materialise(stale(images, saved, gone, catalog.read("failed_files")), "todo")
    if full:
        catalog.replace("embeddings", saved)
    if not todo.isEmpty():
        batches.in_batches(catalog, "embed", "embeddings", work, todo, a_commit)


def cluster(catalog: Catalog) -> DataFrame:
    labels = materialise(clustering.cluster(catalog.embeddings_without_duplicates().select("image_id", "vector")), "clusters")
    catalog.save_clusters(labels)
    return catalog.read("clusters")


def search(catalog: Catalog, query: list[float], top_k: int | None = None, threshold: float = CONFIG.search_slack) -> DataFrame:
    """(path, score, rank) for a query's vector."""
    found = searching.semantic_search(catalog.search_index(), query, top_k, threshold)
    return found.join(catalog.read("images").select("image_id", "path"), "image_id").select("path", "score", "rank").orderBy("rank")


def phash_search(catalog: Catalog, query: int, radius: int = CONFIG.hash_radius, top_k: int | None = CONFIG.search_top) -> DataFrame:
    """(path, distance, rank) for a hash, among the stored ones; the image itself included if it is there."""
    found = duplicates.hash_search(catalog.read("image_hashes"), query, radius, top_k)
    return found.join(catalog.read("images").select("image_id", "path"), "image_id").select("path", "distance", "rank").orderBy("rank")


def prewarm_thumbnails(catalog: Catalog, limit: int | None = None, decoders: dict[str, Callable] | None = None) -> int:
    """Makes thumbnails that are missing or stale, upright; returns how many. decoders: as for `dedup`."""
    todo = materialise(catalog.missing_thumbnails(limit).join(catalog.read("images").select("image_id", "source", "ext"), "image_id"), "todo")
    if todo.isEmpty():
        return 0
    made = thumbnails(rasters.rasters(catalog.spark, todo, decoders, turns=True)).filter("blob is not null")
    new = materialise(made.join(todo.select("path", "mtime", "size"), "path"), "thumbs")
    catalog.save_thumbnails(new)
    return new.count()


def stats(catalog: Catalog) -> DataFrame:
    """The statistics row; duplicates and unique files count as 0 while images wait for their hash."""
    images, failed = catalog.read("images"), catalog.read("failed_files")
    pending = duplicates.pending_dedup(images, catalog.read("image_hashes"), failed).first()["pending"]
    return db_stats(images, catalog.read("dedup_groups"), catalog.read("clusters"), pending)


def reports(catalog: Catalog, folder: str | None = None) -> dict[str, DataFrame]:
    """The reports of scans, duplicates, failures and clusters; with a folder each is written there as JSON lines."""
    images, groups = catalog.read("images"), catalog.read("dedup_groups")
    out = {
        "extensions": report_by_extension(images),
        "duplicates": duplicates.dedup_report(groups, images),
        "largest_groups": duplicates.top_groups(groups),
        "failures": duplicates.failure_reasons(catalog.read("failed_files")),
        "clusters": cluster_report(catalog.read("clusters")),
    }
    for name, rows in out.items() if folder else ():
        rows.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
    return out


def loader(name: str) -> Callable:
    """The model's load function, named as module:function; workers must find the module too (--py-files)."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function or "load")


def decoders_named(names: list[str] | None) -> dict[str, Callable] | None:
    """Decoders by extension from ext=module:function; workers must find the modules too (--py-files)."""
    return {ext.lower().lstrip("."): loader(name) for ext, _, name in (n.partition("=") for n in names)} if names else None


def run_pipeline(catalog: Catalog, roots: list[str], load: Callable | None = None, decoders: dict[str, Callable] | None = None, **options) -> DataFrame:
    """Scan, dedup, and, where there is a model, embed and cluster."""
    scan(catalog, roots, **options)
    dedup(catalog, decoders=decoders)
    if load is not None:
        embed(catalog, load, decoders=decoders)
        cluster(catalog)
    return stats(catalog)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="framewell")
    parser.add_argument("--catalog", required=True, help="folder of the catalog")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("scan", "run"):
        verb = verbs.add_parser(name)
        verb.add_argument("--path", required=True, help="roots, comma-separated")
        verb.add_argument("--ext", default="", help="extensions, comma-separated")
        verb.add_argument("--exclude", default="", help="more directories to pass over")
        verb.add_argument("--min-size", type=int, default=CONFIG.min_size // 1024, help="KB")
        verb.add_argument("--full", action="store_true")
    verbs.choices["run"].add_argument("--model", help="module:function that loads the model; without one, nothing is embedded")
    verb = verbs.add_parser("embed")
    verb.add_argument("--model", required=True, help="module:function that loads the model")
    verb.add_argument("--full", action="store_true")
    verb = verbs.add_parser("search")
    verb.add_argument("query")
    verb.add_argument("--model", required=True, help="module:function that loads the model for texts")
    verb.add_argument("--top-k", type=int)
    verb.add_argument("--threshold", type=float, default=CONFIG.search_slack)
    verbs.add_parser("report").add_argument("--to", help="folder for the reports")
    verbs.add_parser("thumbnails").add_argument("--limit", type=int)
    verb = verbs.add_parser("dedup")
    verb.add_argument("--move")
    verb.add_argument("--full", action="store_true")
    verb = verbs.add_parser("phash-search")
    verb.add_argument("hash", type=lambda x: int(x, 0))
    verb.add_argument("--top-k", type=int, default=CONFIG.search_top)
    for name in ("cluster", "stats", "clear"):
        verbs.add_parser(name)
    for name in ("run", "dedup", "embed", "thumbnails"):
        verbs.choices[name].add_argument("--decoder", action="append", help="ext=module:function that decodes files of this extension; with one, models get decoded pictures")
    o = parser.parse_args(arguments)
    catalog = Catalog(spark or SparkSession.builder.getOrCreate(), o.catalog)
    if o.verb in ("scan", "run"):
        options = {"extensions": split_list(o.ext) or None, "exclude": split_list(o.exclude), "min_size": o.min_size * 1024, "full": o.full}
        if o.verb == "scan":
            scan(catalog, split_list(o.path), **options).groupBy("status").count().show()
        else:
            run_pipeline(catalog, split_list(o.path), loader(o.model) if o.model else None, decoders_named(o.decoder), **options).show()
    elif o.verb == "embed":
        embed(catalog, loader(o.model), o.full, decoders=decoders_named(o.decoder))
    elif o.verb == "search":
        search(catalog, embedding.query_vector(loader(o.model), o.query), o.top_k, o.threshold).show(truncate=False)
    elif o.verb == "report":
        for name, rows in reports(catalog, o.to).items():
            print(name)
            rows.show(truncate=False)
    elif o.verb == "thumbnails":
        print(prewarm_thumbnails(catalog, o.limit, decoders_named(o.decoder)))
    elif o.verb == "dedup":
        dedup(catalog, o.full, move_to=o.move, decoders=decoders_named(o.decoder)).show()
    elif o.verb == "phash-search":
        value = o.hash - (1 << 64) if o.hash >= 1 << 63 else o.hash
        phash_search(catalog, value, top_k=o.top_k).show(truncate=False)
    elif o.verb == "cluster":
        cluster(catalog).groupBy("cluster_id").count().show()
    elif o.verb == "stats":
        stats(catalog).show()
    else:
        catalog.clear()


if __name__ == "__main__":
    main()
