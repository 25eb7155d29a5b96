"""One object for the questions asked of a code map: ``CodeMap(spark, folder)``. Every method returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import identifier_parts, needles, tokens
from graphloom.operators import graph as g
from graphloom.operators import retrieval as rt
from graphloom.plans.graph import area_rollup, epistemic_tier, graph_summary, hubs, surprise
from graphloom.plans.resolve import defs, node_facts
from graphloom.plans.views import graph_edges, graph_nodes
from graphloom.sources.tables import Scratch, table

__all__ = ["CodeMap", "defs", "identifier_parts", "needles", "tokens"]


class CodeMap:
    """The graph of one data folder. Nodes and collapsed edges are written once to the shared folder and read from there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.scratch = Scratch(spark, "map")
        self.nodes = self.scratch.keep(graph_nodes(spark, folder), "nodes")
        self.edges = self.scratch.keep(graph_edges(spark, folder), "edges")

    def _root(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "root string")

    def _deps(self) -> DataFrame:
        return g.of_kinds(self.edges, g.DEPENDENCY)

    def summary(self) -> DataFrame:
        return graph_summary(self.spark, self.folder)

    def areas(self) -> DataFrame:
        return area_rollup(self.spark, self.folder)

    def hubs(self) -> DataFrame:
        return hubs(self.spark, self.folder)

    def oddities(self, n: int = 20) -> DataFrame:
        return surprise(self.spark, self.folder).orderBy(F.desc("surprise"), "kind", "src", "dst").limit(n)

    def node(self, name: str) -> DataFrame:
        """What a name means: by id, file, qualified name, name, name without case, within a name."""
        return rt.cascade(self.nodes, name)

    def ask(self, question: str, k: int = 12) -> DataFrame:
        """The nodes that answer a question best by their words."""
        words = [r for r in self.spark.range(1).select(tokens(F.lit(question)).alias("t")).first()["t"]]
        s = self.nodes.where(~F.col("kind").isin("file", "external") & F.col("name").isNotNull())
        if not words:
            return s.limit(0)
        weight = {r["term"]: r["weight"] for r in rt.idf(s, words).collect()}
        from graphloom.functions.text import WEAK

        return rt.lexical(s, [(w, weight[w], w in WEAK) for w in words]).orderBy(F.desc("score"), "id").limit(k)

    def search_text(self, phrase: str, limit: int = 10_000) -> DataFrame:
        """Lines of the documents that hold a phrase, without case."""
        d = table(self.spark, self.folder, "documents").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        return rt.literal_scan(d, "text", [phrase], ["doc_id"]).orderBy("doc_id", "line").limit(limit)

    def callers(self, node: str) -> DataFrame:
        return g.of_kinds(self.edges, g.USAGE).where(F.col("dst") == node).join(self.nodes.select(F.col("id").alias("src"), "name", "file"), "src")

    def callees(self, node: str) -> DataFrame:
        return g.of_kinds(self.edges, g.USAGE).where(F.col("src") == node).join(self.nodes.select(F.col("id").alias("dst"), "name", "file"), "dst")

    def impact_of(self, *nodes: str, depth: int = 4) -> DataFrame:
        """(root, node, depth, confidence) of what depends on the nodes."""
        return g.impact(self._root(list(nodes)), self._deps(), Scratch(self.spark, "impact"), depth)[0]

    def path_length(self, a: str, b: str) -> DataFrame:
        """(hops) from a to b over edges of all kinds; empty where there is no way."""
        d = g.distances(self._root([a]), self.edges, Scratch(self.spark, "path"))
        return d.where(F.col("node") == b).select("hops")

    def tree(self, node: str, depth: int = 3) -> DataFrame:
        return g.call_tree(self._root([node]), self.edges, Scratch(self.spark, "tree"), depth)

    def tests_for(self, node: str) -> DataFrame:
        """The tests that cover a node or what depends on it."""
        hit = self.impact_of(node).select("node").union(self.spark.createDataFrame([(node,)], "node string"))
        return g.of_kinds(self.edges, ("test",)).join(hit, F.col("dst") == F.col("node")).select(F.col("src").alias("test")).distinct()

    def facts(self, repository: str, file: str) -> DataFrame:
        return node_facts(self.spark, self.folder).where((F.col("repo") == repository) & (F.col("rel") == file))

    def tiers(self) -> DataFrame:
        return epistemic_tier(self.spark, self.folder)

    def save(self, path: str) -> None:
        """A snapshot as parquet: edges clustered by ``dst``, nodes by id, so that point reads skip row groups."""
        self.nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.repartitionByRange("dst", "src").sortWithinPartitions("dst", "src").write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str, folder: str) -> CodeMap:
        m = cls.__new__(cls)
        m.spark, m.folder, m.scratch = spark, folder, Scratch(spark, "map")
        m.nodes, m.edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
        return m
