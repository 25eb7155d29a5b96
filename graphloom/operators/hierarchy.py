"""Trees from parent-child rows: path, depth, root, descendants and cycles.

Subtree sizes are computed upward, sibling ranges are allocated downward by prefix sums, and the
ranges (``pre``, ``pre + size``) are nested sets: u is a descendant of v iff
``v.pre < u.pre < v.pre + v.size`` under the same root. Both passes double their reach each round (a node knows its
2^k-th ancestor after k rounds), so the number of rounds is the logarithm of the depth, not the
depth. Nodes that the upward pass leaves unprocessed hang on a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import clean, clean_or_null, pack
from graphloom.operators.skew import running_sum
from graphloom.sources.tables import Scratch


def parent_rows(edges: DataFrame, kind: str = "contains") -> DataFrame:
    """(node, parent), one row per node that has one: the latest ``kind`` row by ``observed_at`` names the parent.

    Ties in time go to the smallest ``src``, rows without a time come before all others. Rows with a
    null or blank ``dst`` or ``src`` name no pair and are left out. Ids are cleaned and packed.
    """
    e = edges.where(clean("kind") == kind).select(
        clean_or_null("dst").alias("node"), clean_or_null("src").alias("parent"), "observed_at"
    ).where("node is not null and parent is not null")
    e = e.select(pack("node").alias("node"), pack("parent").alias("parent"), "observed_at")
    # latest first, then the smallest parent: both steps combine map-side, so repeated rows cost nothing
    e = e.groupBy("node", "parent").agg(F.max("observed_at").alias("at"))
    at = F.coalesce(F.unix_micros("at"), F.lit(-(1 << 62)))
    return e.groupBy("node").agg(F.min_by("parent", F.struct((-at).alias("t"), F.col("parent"))).alias("parent"))


BLOCK = 256  # preorder numbers of one block in the search for descendants


class Hierarchy:
    """The passes over (node, parent) rows and what is read from them.

    ``pairs`` has one row per child; nodes that only occur as a parent are roots. Null nodes are
    dropped. An empty input gives empty results. A node that is its own parent is a cycle of one.
    """

    def __init__(self, pairs: DataFrame, spark=None):
        self.spark = spark or pairs.sparkSession
        self.scratch = Scratch(self.spark, "hierarchy")
        pairs = pairs.select("node", "parent").where("node is not null")
        self.pairs = self.scratch.keep(pairs, "pairs")
        self._sets: DataFrame | None = None
        self._upward()

    def _upward(self) -> None:
        """Rounds k = 0, 1, ...: ``up`` is the 2^k-th ancestor, or the root once it is reached, with ``hops`` to it; and ``size``.

        S_0 = 1 and S_(k+1)(v) = S_k(v) + the sum of S_k(u) over the u whose 2^k-th ancestor is v: after round k a size counts
        all descendants fewer than 2^(k+1) steps below. A row that reached its root is processed and leaves the rounds; those left when
        a round processes none never will be.
        """
        s = self.scratch
        parents = self.pairs.select(F.col("parent").alias("node")).where("node is not null").distinct()
        roots = parents.join(self.pairs.select("node"), "node", "left_anti")
        roots = s.keep(roots.union(self.pairs.where("parent is null").select("node")).distinct(), "roots")
        # a root is reached when the parent is a root
        live = self.pairs.where("parent is not null").join(
            roots.select(F.col("node").alias("parent"), F.lit(True).alias("is_root")), "parent", "left"
        )
        cur = s.keep(live.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("hops"), F.coalesce("is_root", F.lit(False)).alias("done")), "up0")
        self.rounds, processed = 0, [cur.where("done")]
        # only sums are kept, a size is 1 where there is none
        sums = None
        left, k = cur.where("not done").count(), 0
        while True:
            exact = cur.where(F.col("hops") == F.lit(1 << k)).select("node", "up")
            own = exact.withColumn("size", F.lit(1).cast("long")) if sums is None else exact.join(sums, "node", "left").select("node", "up", F.coalesce("size", F.lit(1)).cast("long").alias("size"))
            more = own.groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
            if sums is None:
                now = more.select("node", (F.col("more") + 1).alias("size"))
            else:
                now = sums.join(more, "node", "full_outer").select("node", (F.coalesce("size", F.lit(1)) + F.coalesce("more", F.lit(0))).alias("size"))
            sums = s.keep(now, f"size{k + 1}")
            s.drop(f"size{k}")
            if not left:
                break
            nxt = s.keep(self._step(cur, processed, {"hops": lambda upper, lower: upper + lower}), f"up{k + 1}")
            stay = nxt.where("not done").count()
            k += 1
            if stay == left:
                cur = nxt
                break  # depths have no gaps: a round that processes no node leaves only cycles and what hangs below them
            processed.append(nxt.where("done"))
            cur, left = nxt, stay
        self.processed, self.loose, self.stuck, self.rounds = self._union(processed), cur.where("not done").select("node", "up"), left > 0, k
        self._size = sums

    def _step(self, cur: DataFrame, processed: list[DataFrame], values: dict) -> DataFrame:
        """One doubling: every row that is not done takes over what its ``up`` knows, whether that is done or not."""
        names = list(values)
        # a hot parent is one key of this join; adaptive execution splits it, as each node stands once on the other side
        far = self._union([cur.select("node", "up", "done", *names), *[x.select("node", "up", "done", *names) for x in processed[:-1]]])
        far = far.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"), *[F.col(n).alias(f"{n}2") for n in names])
        return cur.where("not done").join(far, "up").select(
            "node", F.col("up2").alias("up"), *[values[n](F.col(f"{n}2"), F.col(n)).alias(n) for n in names], F.col("done2").alias("done")
        )

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def rooted(self) -> DataFrame:
        """(node, root, depth) of every node that has a root, the roots included at depth 0."""
        roots = self.spark.read.parquet(self.scratch.path("roots")).select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
        return roots.union(self.processed.select("node", F.col("up").alias("root"), F.col("hops").alias("depth")))

    def unprocessed(self) -> DataFrame:
        """(node): the nodes the upward pass never brings to a root: those on cycles and those below them."""
        return self.loose.select("node")

    def cycles(self) -> DataFrame:
        """(node, cycle): the nodes that are their own ancestors, with the smallest node of their loop.

        They are among the unprocessed nodes. After enough doublings every pointer left lies on a loop and the pointers cover the
        loops; the set shrinks at every step until then, so one doubling that keeps its size ends the search.
        """
        empty = self.pairs.select("node", F.col("node").alias("cycle")).limit(0)
        if not self.stuck:
            return empty
        s, k = self.scratch, 0
        loose = self.loose
        size = -1
        while True:
            image = s.keep(loose.select(F.col("up").alias("node")).distinct(), f"image{k}")
            n = image.count()
            if n == size:
                break
            size = n
            far = loose.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            loose = s.keep(loose.join(far, "up").select("node", F.col("up2").alias("up")), f"loose{k}")
            k += 1
        # on the loops only: the smallest node within 2^j steps, until a round changes none
        cur = s.keep(self.pairs.join(image, "node", "left_semi").select("node", F.col("parent").alias("up"), F.least("node", "parent").alias("low")), "low0")
        j = 0
        while True:
            far = cur.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
            nxt = cur.join(far, "up").select("node", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
            nxt = s.keep(nxt, f"low{j + 1}")
            if not nxt.where("moved").limit(1).count():
                return nxt.select("node", F.col("low").alias("cycle"))
            cur, j = nxt.drop("moved"), j + 1

    def nested_sets(self) -> DataFrame:
        """(node, root, parent, depth, pre, size, path) of every rooted node.

        ``pre`` is the preorder number within the tree, siblings in the order of their ids; the root has 0. ``path`` holds the
        nodes from the root down to the node itself. A node starts one after its parent plus the sizes of its earlier siblings; a
        prefix sum over chunks of siblings finds that, so a parent with a third of all nodes is no single task. The
        starts and the paths come down in one pass.
        """
        if self._sets is not None:
            return self._sets
        s = self.scratch
        inner = self.processed.select("node", F.col("hops").alias("depth"), F.col("up").alias("root"))
        kids = inner.join(self.pairs, "node").join(self._size, "node", "left").select("node", "parent", "root", "depth", F.coalesce("size", F.lit(1)).cast("long").alias("size"))
        step = s.keep(running_sum(kids, ["parent"], ["node"], "size", s, "siblings"), "steps")
        cur = step.select("node", F.col("parent").alias("up"), (F.col("depth") == 1).alias("done"), (F.col("_before") + 1).cast("long").alias("pre"), F.array("node").alias("path"))
        cur, done = s.keep(cur, "down0"), []
        for k in range(self.rounds + 1):
            done.append(cur.where("done"))
            if k == self.rounds:
                break
            nxt = self._step(cur, done, {"pre": lambda upper, lower: upper + lower, "path": F.concat})
            cur = s.keep(nxt, f"down{k + 1}")
        down = self._union(done).select("node", "pre", "path")
        below = step.select("node", "root", "parent", "depth", "size").join(down, "node").select(
            "node", "root", "parent", "depth", "pre", "size", F.concat(F.array("root"), "path").alias("path")
        )
        roots = self.spark.read.parquet(s.path("roots")).join(self._size, "node", "left")
        top = roots.select(
            "node", F.col("node").alias("root"), F.lit(None).cast(self.pairs.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("depth"),
            F.lit(0).cast("long").alias("pre"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.array("node").alias("path"),
        )
        self._sets = s.keep(below.unionByName(top), "sets")
        return self._sets

    def paths(self) -> DataFrame:
        """(node, path): the nodes from the root down to the node itself, as an array, for rooted nodes."""
        return self.nested_sets().select("node", "path")

    def descendants(self, of: DataFrame) -> DataFrame:
        """(node, descendant) for the stated nodes ``of`` (column ``node``), by nested-set ranges within the root.

        Preorder numbers are cut into blocks; a range meets the blocks it covers, so a tree that holds all nodes is as many
        keys as it has blocks.
        """
        sets = self.nested_sets().select("node", "root", "pre", "size")
        top = sets.where("size > 1").join(of.select("node").distinct(), "node", "left_semi").select(
            F.col("node").alias("a"), "root", F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi"),
            F.explode(F.expr(f"sequence((pre + 1) div {BLOCK}, (pre + size - 1) div {BLOCK})")).alias("block"),
        )
        low = sets.select(F.col("node").alias("descendant"), "root", "pre", F.expr(f"pre div {BLOCK}").alias("block"))
        return low.join(top, ["root", "block"]).where("pre > lo and pre < hi").select(F.col("a").alias("node"), "descendant")
