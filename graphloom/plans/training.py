"""Queries p3 (hot keys) and p4 (hierarchies) over the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import clean, clean_or_null, pack, unpack
from graphloom.operators.edges import distinct_edges
from graphloom.operators.hierarchy import Hierarchy, parent_rows
from graphloom.operators.skew import heavy_keys, key_profile
from graphloom.sources.tables import Scratch, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets to which at least 1 % of all distinct edges point."""
    edges = distinct_edges(table(spark, sf_dir, "edges"))
    hot = heavy_keys(edges.select("dst"), "dst", 100, Scratch(spark, "p3"), "edges")
    return hot.select(unpack("dst").alias("dst"))


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target over all delivered rows: how many, first and last time, longest pause between two."""
    e = table(spark, sf_dir, "edges").select(clean_or_null("dst").alias("dst"), "observed_at").where("dst is not null")
    prof = key_profile(e.withColumn("dst", pack("dst")), "dst", "observed_at", Scratch(spark, "p3"), "rows")
    return prof.select(unpack("dst").alias("dst"), "n_rows", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), F.round("longest_gap_s", 3).alias("longest_gap_s"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are their own ancestor, with the smallest id of their loop."""
    tree = Hierarchy(parent_rows(table(spark, sf_dir, "edges")))
    return tree.cycles().select(unpack("node").alias("node_id"), unpack("cycle").alias("cycle_id"))


def p4_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, parent, depth, preorder number, number of descendants and path of every node of the tables.

    A node without a parent or child is its own root. Nodes on a loop or below one have no root: all but their parent is null.
    """
    tree = Hierarchy(parent_rows(table(spark, sf_dir, "edges")))
    sets = tree.nested_sets()
    path = F.array_join(F.transform("path", unpack), "/")
    out = sets.select(
        unpack("node").alias("node_id"), unpack("root").alias("root_id"), unpack("parent").alias("parent_id"), "depth", "pre",
        (F.col("size") - 1).alias("n_descendants"), path.alias("path"),
    )
    none, no_id = F.lit(None).cast("long"), F.lit(None).cast("string")
    lost = tree.unprocessed().join(tree.pairs, "node").select(unpack("node").alias("node_id"), no_id.alias("root_id"), unpack("parent").alias("parent_id"), none.alias("depth"), none.alias("pre"), none.alias("n_descendants"), no_id.alias("path"))
    ids = table(spark, sf_dir, "nodes").select(clean_or_null("node_id").alias("node_id")).where("node_id is not null").distinct()
    zero = F.lit(0).cast("long")
    alone = ids.join(sets.select(unpack("node").alias("node_id")).union(lost.select("node_id")), "node_id", "left_anti")
    alone = alone.select("node_id", F.col("node_id").alias("root_id"), no_id.alias("parent_id"), zero.alias("depth"), zero.alias("pre"), zero.alias("n_descendants"), F.col("node_id").alias("path"))
    return out.unionByName(lost).unionByName(alone)


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node that has a root with each of its descendants, from the nested-set ranges."""
    tree = Hierarchy(parent_rows(table(spark, sf_dir, "edges")))
    d = tree.descendants(tree.nested_sets().select("node"))
    return d.select(unpack("node").alias("node_id"), unpack("descendant").alias("descendant_id"))


_CLEAN = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"


def _c(x: str) -> str:
    return _CLEAN.format(x)


_PARENTS = f"""par AS (
  SELECT node, min_by(parent, row(-epoch_us(ts), parent)) AS parent FROM (
    SELECT {_c('dst')} AS node, {_c('src')} AS parent, max(observed_at) AS ts FROM edges
    WHERE {_c('kind')} = 'contains' AND {_c('dst')} <> '' AND {_c('src')} <> '' GROUP BY 1, 2
  ) GROUP BY node)"""

QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile, "p4_found": p4_found, "p4_tree": p4_tree, "p4_descendants": p4_descendants}

ORACLE = {
    "p3_found": f"""
WITH e AS (SELECT DISTINCT {_c('kind')} AS kind, {_c('src')} AS src, {_c('dst')} AS dst FROM edges WHERE dst IS NOT NULL AND {_c('dst')} <> '')
SELECT dst FROM e GROUP BY dst HAVING count(*) * 100 >= (SELECT count(*) FROM e)""",
    "p3_profile": f"""
WITH e AS (SELECT {_c('dst')} AS dst, epoch_us(observed_at) AS us FROM edges WHERE dst IS NOT NULL AND {_c('dst')} <> ''),
g AS (SELECT dst, us, us - lag(us) OVER (PARTITION BY dst ORDER BY us) AS gap FROM e)
SELECT dst, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us, round(max(gap) / 1e6, 3) AS longest_gap_s FROM g GROUP BY dst""",
    "p4_found": f"""
WITH RECURSIVE {_PARENTS},
walk AS (
  SELECT node AS start, parent AS cur, 1 AS d FROM par
  UNION ALL SELECT start, par.parent, d + 1 FROM walk JOIN par ON par.node = walk.cur WHERE walk.cur <> walk.start AND d < 2000),
cyc AS (SELECT DISTINCT start AS node FROM walk WHERE cur = start),
loops AS (
  SELECT node AS start, node AS cur, 0 AS d FROM cyc
  UNION ALL SELECT start, par.parent, d + 1 FROM loops JOIN par ON par.node = loops.cur WHERE d < 2000 AND (d = 0 OR loops.cur <> loops.start))
SELECT start AS node_id, min(cur) AS cycle_id FROM loops GROUP BY start""",
    "p4_tree": f"""
WITH RECURSIVE {_PARENTS},
roots AS (SELECT DISTINCT parent AS node FROM par WHERE parent NOT IN (SELECT node FROM par)),
t AS (
  SELECT node, node AS root, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, node AS path FROM roots
  UNION ALL SELECT par.node, t.root, par.parent, t.depth + 1, t.path || '/' || par.node FROM t JOIN par ON par.parent = t.node),
up AS (
  SELECT node AS d, parent AS a FROM t WHERE parent IS NOT NULL
  UNION ALL SELECT up.d, par.parent FROM up JOIN par ON par.node = up.a),
n AS (SELECT a AS node, count(*) AS n FROM up GROUP BY a),
l AS (SELECT node, parent FROM par WHERE node NOT IN (SELECT node FROM t))
SELECT node AS node_id, NULL AS root_id, parent AS parent_id, NULL AS depth, NULL AS pre, NULL AS n_descendants, NULL AS path FROM l
UNION ALL SELECT DISTINCT {_c('node_id')}, {_c('node_id')}, NULL, 0, 0, 0, {_c('node_id')} FROM nodes WHERE {_c('node_id')} <> '' AND {_c('node_id')} NOT IN (SELECT node FROM t) AND {_c('node_id')} NOT IN (SELECT node FROM l)
UNION ALL SELECT t.node AS node_id, root AS root_id, parent AS parent_id, CAST(depth AS BIGINT) AS depth,
  row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS pre, coalesce(n.n, 0) AS n_descendants, path
FROM t LEFT JOIN n USING (node)""",
    "p4_descendants": f"""
WITH RECURSIVE {_PARENTS},
roots AS (SELECT DISTINCT parent AS node FROM par WHERE parent NOT IN (SELECT node FROM par)),
t AS (SELECT node, CAST(NULL AS VARCHAR) AS parent FROM roots UNION ALL SELECT par.node, par.parent FROM t JOIN par ON par.parent = t.node),
up AS (SELECT node AS d, parent AS a FROM t WHERE parent IS NOT NULL UNION ALL SELECT up.d, par.parent FROM up JOIN par ON par.node = up.a)
SELECT a AS node_id, d AS descendant_id FROM up""",
}
