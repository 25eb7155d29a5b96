"""Property-graph operators over edges (kind, src, dst, n, conf) and nodes (id, ...).

All are joins and grouped aggregates; traversals are loops over frontiers that are written to the
shared folder each round, so the plan does not grow with the depth. A hot node is one key of a
sort-merge join, which adaptive execution splits; every grouped step combines map-side first.
Null or blank ids never match. Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import clean
from graphloom.functions.numbers import half_up
from graphloom.sources.tables import Scratch

# Kinds of edges that express a dependency.
DEPENDENCY = ("call", "import", "extends", "implements", "references")
USAGE = ("call", "references")
SEMANTIC = ("scip", "stackgraph", "tsc")
TIERS = ("observed", "name-matched", "declared")
DECAY = 0.9


def collapse(edges: DataFrame) -> DataFrame:
    """One row per cleaned (kind, src, dst): ``n`` rows delivered and ``conf``, the greatest confidence (0.5 where none is known).

    Rows with a null or blank kind, src or dst name no edge and are left out.
    """
    e = edges.select(clean("kind").alias("kind"), clean("src").alias("src"), clean("dst").alias("dst"), "confidence")
    e = e.where("kind <> '' and src <> '' and dst <> ''")
    return e.groupBy("kind", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("confidence"), F.lit(0.5)).alias("conf"))


def of_kinds(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds))


def simple(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(src, dst, weight) without loops: the sum of confidence x multiplicity over the kinds; a confidence of 0 weighs 0.5.

    Undirected pairs are given as src < dst.
    """
    e = edges.where("src <> dst")
    if not directed:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "n", "conf")
    w = F.when(F.col("conf") == 0, 0.5).otherwise(F.col("conf")) * F.col("n")
    return e.groupBy("src", "dst").agg(F.sum(w).alias("weight"))


def degrees(pairs: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of every node of the simple directed pairs; a mutual pair counts twice."""
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )).alias("x"))
    g = ends.groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return g.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def normalised(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` over its greatest; unchanged where the greatest is not above 0. One-row aggregate, joined by broadcast."""
    top = df.agg(F.max(value).alias("_top"))
    return df.join(F.broadcast(top)).withColumn(out, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))).drop("_top")


def outliers(df: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """Adds ``threshold`` (mean + sigmas x population deviation) and ``is_hub``: at or above it and above 0."""
    # one row, so the broadcast is bounded whatever the size of the graph
    t = df.agg(half_up(F.avg(value) + F.lit(sigmas) * F.stddev_pop(value), 9).alias("threshold"))
    return df.join(F.broadcast(t)).withColumn("is_hub", (F.col(value) >= F.col("threshold")) & (F.col(value) > 0))


def pagerank(ids: DataFrame, pairs: DataFrame, scratch: Scratch, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank): weighted PageRank in a fixed number of rounds; ranks sum to 1, mass of nodes without an out-edge goes to all.

    Pairs with an end that is no id are left out. The number of rounds and the damping are this library's.
    """
    ids = scratch.keep(ids.select("id").distinct(), "ids")
    out = pairs.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    total = out.groupBy("src").agg(F.sum("weight").alias("total"))
    out = scratch.keep(out.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    ends = out.select("src").distinct()
    rank = scratch.keep(ids.join(ends.withColumn("has", F.lit(True)), ids.id == ends.src, "left").select("id", F.lit(1.0 / n).alias("rank"), F.coalesce("has", F.lit(False)).alias("has")), "rank0")
    for k in range(rounds):
        lost = rank.where("not has").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = out.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = F.lit((1 - damping) / n) + F.lit(damping / n) * F.col("lost")
        nxt = rank.join(got, "id", "left").join(F.broadcast(lost)).select("id", (base + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"), "has")
        rank = scratch.keep(nxt, f"rank{k + 1}")
        scratch.drop(f"rank{k}")
    return rank.select("id", "rank")


def eigenvector(ids: DataFrame, pairs: DataFrame, scratch: Scratch, rounds: int = 5) -> DataFrame:
    """(id, score): power iteration over in-edges, x <- x + A'x, scaled to length 1 each round."""
    ids = scratch.keep(ids.select("id").distinct(), "ids")
    out = pairs.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    out = scratch.keep(out, "pairs")
    x = ids.withColumn("score", F.lit(1.0))
    for k in range(rounds):
        got = out.join(x.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("weight")).alias("got"))
        nxt = scratch.keep(x.join(got, "id", "left").select("id", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("score")), f"raw{k}")
        norm = nxt.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("x")).first()["x"] or 1.0
        x = nxt.withColumn("score", F.col("score") / F.lit(norm))
    return x


def communities(ids: DataFrame, pairs: DataFrame, scratch: Scratch, rounds: int = 4) -> DataFrame:
    """(id, label): synchronous label spreading over undirected weighted pairs, relabelled by the smallest member.

    Each round a node takes the label with the greatest summed weight among its neighbours and itself (its own weighs 1e-6),
    ties to the smallest label; weights are rounded to 6 places first, so the result does not depend on the partitioning.
    """
    both = pairs.select("src", "dst", "weight").union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = scratch.keep(both, "both")
    cur = scratch.keep(ids.select("id").distinct().withColumn("label", F.col("id")), "label0")
    for k in range(rounds):
        votes = both.join(cur.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "weight")
        votes = votes.union(cur.select("id", "label", F.lit(1e-6).alias("weight")))
        votes = votes.groupBy("id", "label").agg(half_up(F.sum("weight"), 6).alias("w"))
        cur = scratch.keep(votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label")).join(ids.select("id").distinct(), "id", "left_semi"), f"label{k + 1}")
    least = cur.groupBy("label").agg(F.min("id").alias("least"))
    return cur.join(least, "label").select("id", F.col("least").alias("label"))


def impact(roots: DataFrame, edges: DataFrame, scratch: Scratch, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Reverse reachability of many roots at once: (root, node, depth, confidence) and (root, min_edge_confidence).

    Breadth first over incoming edges; a node keeps its first visit, that is the least of the ways written as kinds and sources
    in the order they were walked. Confidence is that of the visitor x the edge's x 0.9, rounded to 6 places. The least edge
    confidence is over all edges looked at, those to nodes already visited included. A root is no dependent of itself.
    """
    e = scratch.keep(edges.select("kind", "src", "dst", "conf"), "edges")
    front = scratch.keep(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.lit("").alias("way")), "front0")
    seen, scans = [front], []
    for k in range(1, depth + 1):
        step = front.join(e, front.node == e.dst).select(
            "root", F.col("src").alias("node"), half_up(F.col("confidence") * F.col("conf") * F.lit(DECAY), 6).alias("confidence"),
            F.concat("way", F.lit("|"), "kind", F.lit(":"), "src").alias("way"), "conf",
        )
        # one row for each root and reached node leaves the map side
        got = step.groupBy("root", "node").agg(F.min_by("confidence", "way").alias("confidence"), F.min("way").alias("way"), F.min("conf").alias("low"))
        got = scratch.keep(got, f"step{k}")
        scans.append(got.groupBy("root").agg(F.min("low").alias("low")))
        known = seen[0].select("root", "node")
        for x in seen[1:]:
            known = known.union(x.select("root", "node"))
        front = scratch.keep(got.join(known, ["root", "node"], "left_anti").select("root", "node", F.lit(k).alias("depth"), "confidence", "way"), f"front{k}")
        seen.append(front)
    out, low = seen[1], scans[0]
    for x in seen[2:]:
        out = out.union(x)
    for x in scans[1:]:
        low = low.union(x)
    return out.select("root", "node", "depth", "confidence"), low.groupBy("root").agg(F.min("low").alias("min_edge_confidence"))


def distances(sources: DataFrame, edges: DataFrame, scratch: Scratch, limit: int | None = None) -> DataFrame:
    """(root, node, hops) over directed edges of all kinds, breadth first from many sources until nothing new is reached (or ``limit``)."""
    e = scratch.keep(edges.select("src", "dst").where("src <> dst").distinct(), "hops")
    front = scratch.keep(sources.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")), "d0")
    seen, k = front, 0
    while (limit is None or k < limit) and front.limit(1).count():
        k += 1
        new = front.join(e, front.node == e.src).select("root", F.col("dst").alias("node")).distinct()
        front = scratch.keep(new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hops", F.lit(k)), f"d{k}")
        seen = seen.union(front)
        if k % 4 == 0:  # one table again, so that the plan stays small however deep the graph is
            seen = scratch.keep(seen, f"seen{k}")
    return seen


def call_tree(roots: DataFrame, edges: DataFrame, scratch: Scratch, depth: int = 3) -> DataFrame:
    """(root, node, depth, path): every way of calls from the roots, as arrays of ids, down to ``depth``; a way never meets a node twice."""
    e = scratch.keep(of_kinds(edges, ("call",)).select("src", "dst").distinct(), "calls")
    cur = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path"))
    out = cur
    for k in range(1, depth + 1):
        cur = cur.join(e, cur.node == e.src).where(~F.array_contains("path", F.col("dst")))
        cur = scratch.keep(cur.select("root", F.col("dst").alias("node"), F.lit(k).alias("depth"), F.concat("path", F.array("dst")).alias("path")), f"tree{k}")
        out = out.union(cur)
    return out


def loops(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, loop): the strongly connected components of more than one node, named by their greatest node.

    Nodes without an in- or out-edge are trimmed, then the greatest id that reaches a node spreads forward to
    a fixed point; what reaches that id backward within its colour is its component; the rest goes round again.
    """
    e = scratch.keep(pairs.select("src", "dst").where("src <> dst").distinct(), "e0")
    found, n = None, 0
    while True:
        # trimming ends when a round drops no edge; then only loops and ways between them are left
        size = e.count()
        while size:
            n += 1
            kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            e = scratch.keep(kept.select("src", "dst"), f"e{n}")
            now = e.count()
            if now == size:
                break
            size = now
        if not size:
            break
        ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
        colour = scratch.keep(ids.withColumn("colour", F.col("id")), f"c{n}-0")
        k = 0
        while True:
            k += 1
            up = e.join(colour, e.src == colour.id).groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("up"))
            nxt = colour.join(up, "id", "left").select("id", F.greatest("colour", "up").alias("colour"), (F.coalesce("up", F.lit("")) > F.col("colour")).alias("moved"))
            nxt = scratch.keep(nxt, f"c{n}-{k}")
            colour = nxt.drop("moved")
            if not nxt.where("moved").limit(1).count():
                break
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        inside = scratch.keep(inside.select("src", "dst", F.col("a").alias("colour")), f"in{n}")
        back = scratch.keep(colour.where("id = colour").select("id", "colour"), f"b{n}-0")
        front, k = back, 0
        while front.limit(1).count():
            k += 1
            new = inside.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = scratch.keep(new.join(back.select("id"), "id", "left_anti"), f"b{n}-{k}")
            back = back.union(front)
        part = scratch.keep(back, f"scc{n}")
        found = part if found is None else found.union(part)
        n += 1
        e = scratch.keep(e.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), f"e{n}")
    if found is None:
        return e.select(F.col("src").alias("id"), F.col("dst").alias("loop")).limit(0)
    big = found.groupBy("colour").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return found.join(big, "colour").select("id", F.col("colour").alias("loop"))


def epistemic(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``tier`` to edge rows (kind, dst, resolution): observed, name-matched or declared.

    A semantic resolver observed its target; containment is observed; an import is observed where its target is a node of
    the graph that is no external one; tests and coverage are declared; anything else was matched by name.
    """
    e = edges.join(nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), "dst", "left")
    inner = F.col("dst_kind").isNotNull() & (F.col("dst_kind") != "external")
    tier = (
        F.when(F.col("resolution").isin(*SEMANTIC), "observed").when(F.col("kind") == "contains", "observed")
        .when(F.col("kind") == "import", F.when(inner, "observed").otherwise("declared"))
        .when(F.col("kind").isin("test", "coverage"), "declared").otherwise("name-matched")
    )
    return e.withColumn("tier", tier)


def contract(edges: DataFrame, nodes: DataFrame, onto: str) -> DataFrame:
    """(kind, src, dst, n): edges between the groups ``onto`` of their ends; edges within a group and ends without one are dropped."""
    a = nodes.where(F.col(onto).isNotNull()).select(F.col("id").alias("src"), F.col(onto).alias("a"))
    b = nodes.where(F.col(onto).isNotNull()).select(F.col("id").alias("dst"), F.col(onto).alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").groupBy("kind", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def areas(edges: DataFrame, nodes: DataFrame, area: str = "area") -> DataFrame:
    """(area, size, label, internal, external, cohesion): label is the most important member's qualified name, ties to the smallest id.

    A crossing edge counts as external on both sides; cohesion is internal / (internal + external), 0 where an area has no edge.
    """
    n = nodes.where(F.col(area).isNotNull())
    top = n.groupBy(area).agg(
        F.count(F.lit(1)).alias("size"), F.min_by("qname", F.struct(-F.coalesce("importance", F.lit(0.0)), F.col("id"))).alias("label")
    )
    ends = edges.join(n.select(F.col("id").alias("src"), F.col(area).alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col(area).alias("b")), "dst")
    side = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    per = ends.select(F.explode(side).alias(area), (F.col("a") == F.col("b")).alias("inside")).groupBy(area).agg(
        F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external")
    )
    out = top.join(per, area, "left").fillna(0, ["internal", "external"])
    whole = F.col("internal") + F.col("external")
    return out.withColumn("cohesion", half_up(F.when(whole > 0, F.col("internal") / whole).otherwise(0.0), 6))


def surprise(edges: DataFrame, nodes: DataFrame, area: str = "area") -> DataFrame:
    """(kind, src, dst, surprise): 1 / the number of edges between the two areas, for edges that cross areas."""
    n = nodes.where(F.col(area).isNotNull())
    ends = edges.join(n.select(F.col("id").alias("src"), F.col(area).alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col(area).alias("b")), "dst")
    ends = ends.where("a <> b").select("kind", "src", "dst", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # a join on the counts, not a window: a window would hold all edges between two large areas in one task
    count = ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"))
    return ends.join(count, ["a", "b"]).select("kind", "src", "dst", half_up(1 / F.col("pairs"), 6).alias("surprise"))


def dependents(roots: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, direct_count, depth2_count, files): distinct dependents one step away, those first met at two, and the files of both."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    one = roots.join(e, roots.root == e.dst).select("root", F.col("src").alias("node"), F.lit(1).alias("d"))
    e2 = e.select(F.col("src").alias("far"), F.col("dst").alias("node"))
    two = one.join(e2, "node").where("far <> root").select("root", F.col("far").alias("node"), F.lit(2).alias("d")).distinct()
    every = one.union(two).groupBy("root", "node").agg(F.min("d").alias("d"))
    every = every.join(nodes.select(F.col("id").alias("node"), "file"), "node", "left")
    per = every.groupBy("root").agg(F.count_if(F.col("d") == 1).alias("direct_count"), F.count_if(F.col("d") == 2).alias("depth2_count"), F.countDistinct("file").alias("files"))
    return roots.join(per, "root", "left").fillna(0, ["direct_count", "depth2_count", "files"])


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in a total order, numbered from 1. Spark's group limit keeps k rows a task before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(out) <= k)
