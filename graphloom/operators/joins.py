"""Joins by meaning: intervals, ladders, overlays, longest prefixes, version windows, snapshots.

Every one is an equi join on the narrowest key with the rest as a condition, then a grouped pick;
picks are ``min_by`` aggregates, which combine before the shuffle, rather than windows.
Rows with a null in a join key match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import ancestors, base_name, directory, join_relative
from graphloom.functions.versions import in_window


def enclosing(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, low: str, high: str, ids: Sequence[str], order: str) -> DataFrame:
    """``points`` with the smallest span that holds them: its columns ``ids`` (null without one); equal widths go to the least ``order``.

    ``points`` needs ``point_id``, unique per row. Bounds are inclusive; a span with a null bound holds nothing.
    """
    s = spans.select(*key, F.col(low).alias("_low"), F.col(high).alias("_high"), F.col(order).alias("_ord"), *ids)
    hit = points.select("point_id", *key, F.col(at).alias("_at")).join(s, list(key)).where("_low <= _at and _at <= _high")
    best = hit.groupBy("point_id").agg(F.min_by(F.struct(*ids), F.struct((F.col("_high") - F.col("_low")).alias("w"), F.col("_ord"))).alias("_best"))
    return points.join(best, "point_id", "left").select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in ids])


def nearest(points: DataFrame, rows: DataFrame, key: Sequence[str], at: str, when: str, take: Sequence[str]) -> DataFrame:
    """As-of join: ``points`` with the columns ``take`` of the latest row of their key not after ``at`` (ties: the greatest ``take``).

    Both sides are merged into one ordered run per key, so no pair of rows is built; ``point_id`` must be unique.
    """
    from pyspark.sql import Window

    a = points.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_side"), "point_id", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in take])
    b = rows.select(*key, F.col(when).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), *take)
    w = Window.partitionBy(*key).orderBy("_t", "_side", *take).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct(*take)), ignorenulls=True).over(w)
    got = a.unionByName(b).where("_t is not null").withColumn("_got", last).where("_side = 1").select("point_id", *[F.col(f"_got.{c}").alias(c) for c in take])
    return points.join(got, "point_id", "left")


def owners(items: DataFrame, path: str, folders: DataFrame, folder: str, take: Sequence[str]) -> DataFrame:
    """``items`` with ``take`` of the longest ``folder`` above their path, null without one.

    The directories above each path are looked up by equality, so nothing is compared with every folder. ``item_id`` must be unique.
    """
    up = items.select("item_id", F.posexplode(ancestors(F.col(path))).alias("_up", "_dir"))
    f = folders.groupBy(F.col(folder).alias("_dir")).agg(F.min(F.struct(*take)).alias("_f"))
    best = up.join(f, "_dir").groupBy("item_id").agg(F.min_by("_f", "_up").alias("_f"))
    return items.join(best, "item_id", "left").select(*items.columns, *[F.col(f"_f.{c}").alias(c) for c in take])


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, rel, spec, target, how) of imports (repo, rel, spec) over files (repo, rel).

    A relative specifier is resolved against its file, with its extension as written, as ts for js, or with any extension the
    repository has (the least path). A plain or dotted name matches files whose path without extension ends with it: the one
    with most leading directories in common wins, then the least path. What is found nowhere is external.
    """
    bare = F.regexp_replace("rel", r"\.[A-Za-z0-9]+$", "")
    f = files.select("repo", F.col("rel").alias("target"), bare.alias("stem")).distinct()
    i = imports.select("repo", "rel", "spec").where("spec is not null and spec <> ''").distinct()
    want = join_relative(directory(F.col("rel")), F.col("spec"))
    near = i.where(F.col("spec").rlike(r"^\.\.?/")).withColumn("want", want).withColumn("stem", F.regexp_replace("want", r"\.(js|ts|mjs|jsx|tsx)$", ""))
    near = near.join(f, ["repo", "stem"]).groupBy("repo", "rel", "spec").agg(
        F.min_by("target", F.struct((F.col("target") != F.col("want")).alias("other"), F.col("target"))).alias("target")
    ).withColumn("how", F.lit("relative"))
    # every tail of a path is a key: ``a/b/c`` can be named c, b/c and a/b/c
    parts = F.split("stem", "/")
    tails = f.select("repo", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("tail"))
    far = i.where(~F.col("spec").rlike(r"^\.\.?/")).withColumn("tail", F.regexp_replace("spec", r"[.:]+", "/")).join(tails, ["repo", "tail"])
    a, b = F.split(directory(F.col("rel")), "/"), F.split(directory(F.col("target")), "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda k: F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k)))
    far = far.where("target <> rel").groupBy("repo", "rel", "spec").agg(F.min_by("target", F.struct((-shared).alias("s"), F.col("target"))).alias("target")).withColumn("how", F.lit("suffix"))
    found = near.unionByName(far)
    return i.join(found, ["repo", "rel", "spec"], "left").withColumn("how", F.coalesce("how", F.lit("external")))


def resolve_calls(calls: DataFrame, defs: DataFrame, reach: DataFrame) -> DataFrame:
    """(repo, rel, ord, callee, target_rel, target_ord, confidence, rung) of calls (repo, rel, ord, callee).

    The ladder: one definition of the name in the file (0.85), several there (0.4, the first), exactly one in the files it
    reaches (0.75, ``reach``: repo, rel, target). Anything ambiguous stays unresolved: no row is picked by chance.
    """
    d = defs.select("repo", F.col("rel").alias("target_rel"), F.col("ord").alias("target_ord"), F.col("name").alias("callee"))
    here = calls.join(d.withColumnRenamed("target_rel", "rel"), ["repo", "rel", "callee"]).groupBy("repo", "rel", "ord", "callee").agg(
        F.count(F.lit(1)).alias("k"), F.min("target_ord").alias("target_ord")
    )
    here = here.select("repo", "rel", "ord", "callee", F.col("rel").alias("target_rel"), "target_ord", F.when(F.col("k") == 1, 0.85).otherwise(0.4).alias("confidence"), F.when(F.col("k") == 1, "file").otherwise("file-first").alias("rung"))
    left = calls.join(here.select("repo", "rel", "ord"), ["repo", "rel", "ord"], "left_anti")
    r = reach.where("target is not null and target <> rel").select("repo", "rel", F.col("target").alias("target_rel")).distinct()
    far = left.join(r, ["repo", "rel"]).join(d, ["repo", "target_rel", "callee"]).groupBy("repo", "rel", "ord", "callee").agg(
        F.count(F.lit(1)).alias("k"), F.min("target_rel").alias("target_rel"), F.min("target_ord").alias("target_ord")
    ).where("k = 1")
    far = far.select("repo", "rel", "ord", "callee", "target_rel", "target_ord", F.lit(0.75).alias("confidence"), F.lit("reach").alias("rung"))
    done = here.unionByName(far)
    return calls.select("repo", "rel", "ord", "callee").join(done, ["repo", "rel", "ord", "callee"], "left")


def families(names: DataFrame, heritage: DataFrame) -> DataFrame:
    """(name, pick): for names that several nodes bear, the node all others of the name extend, if there is exactly one such.

    ``names`` has name, id; ``heritage`` has src, dst (src extends dst).
    """
    many = names.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    n = names.join(many, "name")
    up = n.select("name", "k", F.col("id").alias("src")).join(heritage, "src").join(n.select("name", F.col("id").alias("dst")), ["name", "dst"])
    anchors = up.where("src <> dst").groupBy("name", "k", "dst").agg(F.countDistinct("src").alias("below")).where("below = k - 1")
    return anchors.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.min("dst").alias("pick")).where("c = 1").select("name", "pick")


def merge_precise(guessed: DataFrame, precise: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (kind, src, dst, conf) after precise ones came: guesses out of files that precise edges cover are dropped, then
    both are united and a precise edge stands for an equal guess. ``files`` has id, file."""
    f = files.select(F.col("id").alias("src"), "file")
    covered = precise.join(f, "src").select("file").where("file is not null").distinct()
    kept = guessed.join(f, "src", "left").join(covered, "file", "left_anti").select("kind", "src", "dst", "conf", F.lit(1).alias("rank"))
    both = precise.select("kind", "src", "dst", "conf", F.lit(0).alias("rank")).unionByName(kept)
    return both.groupBy("kind", "src", "dst").agg(F.min(F.struct("rank", "conf")).alias("x")).select("kind", "src", "dst", "x.conf", (F.col("x.rank") == 0).alias("precise"))


def overlay(nodes: DataFrame, edges: DataFrame, dirty: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The graph with dirty files read anew: nodes of dirty files (``key``) are replaced by the new ones; edges need both ends."""
    n = nodes.join(dirty.select(*key).distinct(), list(key), "left_anti").unionByName(new_nodes)
    ids = n.select("id").distinct()
    e = edges.unionByName(new_edges).distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return n, e


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, old, new, status): added, removed, changed or same by a null-safe compare of ``value``; keys are unique on each side."""
    a = old.select(*key, F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = new.select(*key, F.col(value).alias("new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, list(key), "full_outer").withColumn("status", status).drop("_a", "_b")


def affected(items: DataFrame, windows: DataFrame, key: str, v: str, empty_matches: bool = True) -> DataFrame:
    """``items`` joined with each window (``key``, introduced, fixed) of their package that holds their version ``v``.

    A null bound is open. A window without both bounds holds everything (``empty_matches``) or, in the evidence reading, nothing.
    """
    w = windows if empty_matches else windows.where("introduced is not null or fixed is not null")
    return items.join(w, key).where(in_window(F.col(v), F.col("introduced"), F.col("fixed")))


def shared_keys(rows: DataFrame, key: str, site: str, least: int = 2) -> DataFrame:
    """Membership (key, site) of keys found at ``least`` sites or more, with their number of sites; no pairs are written out."""
    d = rows.where(F.col(key).isNotNull() & F.col(site).isNotNull()).select(key, site).distinct()
    many = d.groupBy(key).agg(F.count(F.lit(1)).alias("n_sites")).where(F.col("n_sites") >= least)
    return d.join(many, key)


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], take: Sequence[str]) -> DataFrame:
    """One row per key: ``take`` of the row that is greatest by ``order`` (make it total)."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in take])


__all__ = [
    "affected", "base_name", "enclosing", "families", "latest", "merge_precise", "nearest", "overlay", "owners", "resolve_calls", "resolve_modules",
    "shared_keys", "snapshot_diff",
]
