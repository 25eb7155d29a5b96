"""Folded views of the graph tables, for Spark and in SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import clean
from graphloom.functions.paths import clean_path
from graphloom.operators.graph import collapse
from graphloom.sources.tables import table


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, src, dst, n, conf): the collapsed edges of the whole table."""
    return collapse(table(spark, sf_dir, "edges"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cleaned node id; columns of repeated rows fold to their least value, importance and span_end to the greatest."""
    low = ["repository_id", "node_name", "qualified_name", "span_start", "lang", "area", "visibility", "signature", "doc"]
    t = table(spark, sf_dir, "nodes").withColumn("id", clean("node_id")).where("id <> ''")
    return t.groupBy("id").agg(
        F.min(clean("kind")).alias("kind"), F.min(clean_path("file")).alias("file"), *[F.min(c).alias(c) for c in low],
        F.max("span_end").alias("span_end"), F.max("importance").alias("importance"), F.max("tested").alias("tested"),
    ).withColumnsRenamed({"node_name": "name", "qualified_name": "qname"})


def hub_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated roots of the traversal queries: the nodes of the hub table, a fixed set."""
    return table(spark, sf_dir, "hub_summaries").select(clean("node_id").alias("root")).where("root <> ''").distinct()


def c(x: str) -> str:
    """SQL of a cleaned id or kind."""
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


def p(x: str) -> str:
    """SQL of a cleaned path."""
    x = f"replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\', '/')"
    for a, b, g in (("^/srv/checkouts/[^/]+/", "", ""), ("^file://", "", ""), ("/(?:\\./)+", "/", "g"), ("/{2,}", "/", "g"), ("^(?:\\./|/)+", "", "")):
        x = f"regexp_replace({x}, '{a}', '{b}'{', ' + repr(g) if g else ''})"
    return x


E = f"""e AS (SELECT kind, src, dst, count(*) AS n, coalesce(max(confidence), 0.5) AS conf FROM (
  SELECT {c('kind')} AS kind, {c('src')} AS src, {c('dst')} AS dst, confidence FROM edges) WHERE kind <> '' AND src <> '' AND dst <> '' GROUP BY 1, 2, 3)"""
N = f"""n AS (SELECT {c('node_id')} AS id, min({c('kind')}) AS kind, min({p('file')}) AS file, min(repository_id) AS repository_id, min(node_name) AS name,
  min(qualified_name) AS qname, min(span_start) AS span_start, min(lang) AS lang, min(area) AS area, min(visibility) AS visibility, min(signature) AS signature, min(doc) AS doc,
  max(span_end) AS span_end, max(importance) AS importance, max(tested) AS tested FROM nodes WHERE {c('node_id')} <> '' GROUP BY 1)"""
R = f"r AS (SELECT DISTINCT {c('node_id')} AS root FROM hub_summaries WHERE {c('node_id')} <> '')"
DEP_SQL = "('call', 'import', 'extends', 'implements', 'references')"


def r6(x: str, places: int = 6) -> str:
    """SQL of ``half_up``."""
    s = float(10**places)
    return f"(floor(({x}) * {s} + 0.5) / {s})"
