"""Queries of the graph family over ``nodes`` and ``edges``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import clean
from graphloom.functions.numbers import half_up
from graphloom.functions.paths import is_test_file
from graphloom.operators import graph as g
from graphloom.plans.views import DEP_SQL, E, N, R, c, graph_edges, graph_nodes, hub_ids, p, r6
from graphloom.sources.tables import Scratch, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_DEP = f"d AS (SELECT * FROM e WHERE kind IN {DEP_SQL})"
_SIMPLE = "s AS (SELECT src, dst, sum(CASE WHEN conf = 0 THEN 0.5 ELSE conf END * n) AS weight FROM d WHERE src <> dst GROUP BY 1, 2)"
_INNER = "i AS (SELECT s.* FROM s WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))"


def _dep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.of_kinds(graph_edges(spark, sf_dir), g.DEPENDENCY)


@query(f"WITH {E} SELECT kind, src, dst, n, conf FROM e")
def edge_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges, delivered rows folded."""
    return graph_edges(spark, sf_dir)


@query(f"""WITH {E}, {_DEP} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, {r6('sum(CASE WHEN conf = 0 THEN 0.5 ELSE conf END * n)', 4)} AS weight
FROM d WHERE src <> dst GROUP BY 1, 2""")
def simple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The undirected weighted graph of dependencies."""
    return g.simple(_dep(spark, sf_dir), directed=False).withColumn("weight", half_up(F.col("weight"), 4))


_DEGREE = "deg AS (SELECT id, sum(i) AS in_degree, sum(o) AS out_degree, sum(i) + sum(o) AS degree FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM s UNION ALL SELECT src, 0, 1 FROM s) GROUP BY id)"


@query(f"WITH {E}, {_DEP}, {_SIMPLE}, {_DEGREE} SELECT id, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(degree AS BIGINT) AS degree FROM deg")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In- and out-degree of every node of the simple graph."""
    return g.degrees(g.simple(_dep(spark, sf_dir)))


@query(f"""WITH {E}, {_DEP}, {_SIMPLE}, {_DEGREE}, m AS (SELECT id, {r6('degree / (SELECT max(degree) FROM deg)', 9)} AS score FROM deg),
t AS (SELECT {r6('avg(score) + 2 * stddev_pop(score)', 9)} AS threshold FROM m)
SELECT id, score, threshold FROM m, t WHERE score >= threshold AND score > 0""")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers of the normalised degree: at least mean + 2 population deviations."""
    d = g.normalised(degree(spark, sf_dir), "degree", "score").select("id", half_up(F.col("score"), 9).alias("score"))
    return g.outliers(d, "score").where("is_hub").select("id", "score", "threshold")


def _pagerank_sql(rounds: int) -> str:
    q = f"""{E}, {_DEP}, {_SIMPLE}, {N}, {_INNER}, w AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM i),
cnt AS (SELECT count(*) AS k FROM n), has AS (SELECT DISTINCT src FROM w), p0 AS (SELECT id, 1.0::DOUBLE / k AS rank FROM n, cnt)"""
    for j in range(rounds):
        q += f""", l{j} AS (SELECT coalesce(sum(rank), 0) AS x FROM p{j} WHERE id NOT IN (SELECT src FROM has)),
g{j} AS (SELECT dst AS id, sum(rank * share) AS got FROM w JOIN p{j} ON p{j}.id = w.src GROUP BY dst),
p{j + 1} AS MATERIALIZED (SELECT p{j}.id, 0.15::DOUBLE / k + 0.85::DOUBLE * x / k + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM p{j} LEFT JOIN g{j} USING (id), cnt, l{j})"""
    return q


@query(f"WITH {_pagerank_sql(10)} SELECT id, {r6('rank * k', 5)} AS rank FROM p10, cnt")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of every node after 10 rounds, relative to the even share."""
    nodes = graph_nodes(spark, sf_dir).select("id")
    r = g.pagerank(nodes, g.simple(_dep(spark, sf_dir)), Scratch(spark, "pagerank"))
    return r.join(F.broadcast(r.agg(F.count(F.lit(1)).alias("k")))).select("id", half_up(F.col("rank") * F.col("k"), 5).alias("rank"))


@query(f"""WITH {_pagerank_sql(10)}, {_DEGREE}, x AS (SELECT p10.id, p10.rank / (SELECT max(rank) FROM p10) AS a, coalesce(degree, 0) / (SELECT max(degree) FROM deg) AS b FROM p10 LEFT JOIN deg USING (id)),
y AS (SELECT id, 0.7 * a + 0.3 * b AS v FROM x) SELECT id, {r6('v / (SELECT max(v) FROM y)', 5)} AS importance FROM y""")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 of the normalised PageRank and 0.3 of the normalised degree, normalised again."""
    scratch = Scratch(spark, "importance")
    pairs = scratch.keep(g.simple(_dep(spark, sf_dir)), "simple")
    rank = g.normalised(g.pagerank(graph_nodes(spark, sf_dir).select("id"), pairs, Scratch(spark, "pagerank")), "rank", "a")
    both = rank.join(g.normalised(g.degrees(pairs), "degree", "b").select("id", "b"), "id", "left")
    v = both.select("id", (0.7 * F.col("a") + 0.3 * F.coalesce("b", F.lit(0.0))).alias("v"))
    return g.normalised(v, "v", "importance").select("id", half_up(F.col("importance"), 5).alias("importance"))


def _eigen_sql(rounds: int) -> str:
    q = f"{E}, {_DEP}, {_SIMPLE}, {N}, {_INNER}, x0 AS (SELECT id, 1.0::DOUBLE AS v FROM n)"
    for j in range(rounds):
        q += f""", y{j} AS (SELECT x{j}.id, v + coalesce(got, 0) AS v FROM x{j} LEFT JOIN (SELECT dst AS id, sum(v * weight) AS got FROM i JOIN x{j} ON id = src GROUP BY dst) USING (id)),
x{j + 1} AS MATERIALIZED (SELECT id, v / (SELECT sqrt(sum(v * v)) FROM y{j}) AS v FROM y{j})"""
    return q


@query(f"WITH {_eigen_sql(5)} SELECT id, {r6('v', 6)} AS score FROM x5")
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvector centrality after 5 rounds."""
    x = g.eigenvector(graph_nodes(spark, sf_dir), g.simple(_dep(spark, sf_dir)), Scratch(spark, "eigenvector"))
    return x.select("id", half_up(F.col("score"), 6).alias("score"))


def _label_sql(rounds: int) -> str:
    q = f"""{E}, k AS (SELECT * FROM e WHERE kind IN {DEP_SQL} OR kind = 'contains'), {N},
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN conf = 0 THEN 0.5 ELSE conf END * n) AS weight FROM k WHERE src <> dst GROUP BY 1, 2),
bo AS (SELECT a AS src, b AS dst, weight FROM u UNION ALL SELECT b, a, weight FROM u), c0 AS (SELECT id, id AS label FROM n)"""
    for j in range(rounds):
        q += f""", v{j} AS (SELECT id, label, {r6('sum(weight)')} AS w FROM (SELECT src AS id, label, weight FROM bo JOIN c{j} ON c{j}.id = dst UNION ALL SELECT id, label, 1e-6 FROM c{j}) GROUP BY 1, 2),
c{j + 1} AS MATERIALIZED (SELECT id, arg_min(label, row(-w, label)) AS label FROM v{j} WHERE id IN (SELECT id FROM n) GROUP BY id)"""
    return q + f", f AS (SELECT id, min(id) OVER (PARTITION BY label) AS label FROM c{rounds})"


@query(f"WITH {_label_sql(4)} SELECT id, label FROM f")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The community of every node: four rounds of label spreading over dependencies and containment."""
    e = g.of_kinds(graph_edges(spark, sf_dir), (*g.DEPENDENCY, "contains"))
    return g.communities(graph_nodes(spark, sf_dir), g.simple(e, directed=False), Scratch(spark, "communities"))


@query(f"""WITH {E}, {_DEP}, {N}, x AS (SELECT a.area AS a, b.area AS b FROM d JOIN n a ON a.id = d.src JOIN n b ON b.id = d.dst WHERE a.area IS NOT NULL AND b.area IS NOT NULL),
y AS (SELECT a AS area, a = b AS inside FROM x UNION ALL SELECT b, false FROM x WHERE a <> b),
z AS (SELECT area, count(*) FILTER (inside) AS internal, count(*) FILTER (NOT inside) AS external FROM y GROUP BY area),
t AS (SELECT area, count(*) AS size, arg_min(qname, row(-coalesce(importance, 0), id)) AS label FROM n WHERE area IS NOT NULL GROUP BY area)
SELECT area, size, label, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external,
{r6('CASE WHEN coalesce(internal + external, 0) > 0 THEN internal / (internal + external) ELSE 0 END')} AS cohesion FROM t LEFT JOIN z USING (area)""")
def area_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, label, inner and crossing dependencies and cohesion of every area."""
    return g.areas(_dep(spark, sf_dir), graph_nodes(spark, sf_dir))


@query(f"""WITH {E}, {_DEP}, {N}, x AS (SELECT d.kind, src, dst, least(a.area, b.area) AS a, greatest(a.area, b.area) AS b FROM d JOIN n a ON a.id = d.src JOIN n b ON b.id = d.dst WHERE a.area <> b.area)
SELECT kind, src, dst, {r6('1.0::DOUBLE / count(*) OVER (PARTITION BY a, b)')} AS surprise FROM x""")
def surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rare the crossing of each dependency between two areas is."""
    return g.surprise(_dep(spark, sf_dir), graph_nodes(spark, sf_dir))


_LATEST = f"""l AS (SELECT kind, src, dst, max(resolution) AS resolution FROM (SELECT {c('kind')} AS kind, {c('src')} AS src, {c('dst')} AS dst, resolution FROM edges)
  WHERE kind <> '' AND src <> '' AND dst <> '' GROUP BY 1, 2, 3)"""
_TIER = """CASE WHEN resolution IN ('scip', 'stackgraph', 'tsc') OR l.kind = 'contains' THEN 'observed'
  WHEN l.kind = 'import' THEN CASE WHEN n.kind IS NOT NULL AND n.kind <> 'external' THEN 'observed' ELSE 'declared' END
  WHEN l.kind IN ('test', 'coverage') THEN 'declared' ELSE 'name-matched' END"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges").select(clean("kind").alias("kind"), clean("src").alias("src"), clean("dst").alias("dst"), "resolution")
    return e.where("kind <> '' and src <> '' and dst <> ''").groupBy("kind", "src", "dst").agg(F.max("resolution").alias("resolution"))


@query(f"WITH {_LATEST}, {N} SELECT l.kind, src, dst, {_TIER} AS tier FROM l LEFT JOIN n ON n.id = dst")
def epistemic_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each edge is known: observed, matched by name, or declared."""
    return g.epistemic(_resolved(spark, sf_dir), graph_nodes(spark, sf_dir)).select("kind", "src", "dst", "tier")


@query(f"""WITH {_LATEST}, {N}, t AS (SELECT {_TIER} AS tier FROM l LEFT JOIN n ON n.id = dst)
SELECT v.tier, count(t.tier) AS n FROM (VALUES ('observed'), ('name-matched'), ('declared')) v(tier) LEFT JOIN t ON t.tier = v.tier GROUP BY v.tier""")
def epistemic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges per tier, all tiers present."""
    per = epistemic_tier(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    tiers = spark.createDataFrame([(t,) for t in g.TIERS], "tier string")
    return tiers.join(per, "tier", "left").fillna(0, ["n"])


@query(f"WITH {E}, {N} SELECT e.kind, a.file AS src, b.file AS dst, count(*) AS n FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.file <> b.file GROUP BY 1, 2, 3")
def contract_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between files."""
    return g.contract(graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir), "file")


@query(f"""WITH RECURSIVE {E}, {N}, f AS (SELECT DISTINCT a.repository_id || ':' || a.file AS src, b.repository_id || ':' || b.file AS dst FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst
  WHERE e.kind = 'import' AND a.repository_id = b.repository_id AND a.file <> b.file),
w AS (SELECT src, dst FROM f UNION SELECT w.src, f.dst FROM w JOIN f ON f.src = w.dst)
SELECT a.src AS id, max(a.dst) AS loop FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(DISTINCT a.dst) > 1""")
def import_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that import each other in a circle within a repository, with the greatest file of their circle."""
    n = graph_nodes(spark, sf_dir).where("file is not null and repository_id is not null").withColumn("at", F.concat_ws(":", "repository_id", "file"))
    e = g.of_kinds(graph_edges(spark, sf_dir), ("import",))
    e = e.join(n.select(F.col("id").alias("src"), F.col("at").alias("a"), F.col("repository_id").alias("ra")), "src").join(n.select(F.col("id").alias("dst"), F.col("at").alias("b"), F.col("repository_id").alias("rb")), "dst")
    return g.loops(e.where("ra = rb and a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")), Scratch(spark, "loops"))


def _impact_sql(depth: int) -> str:
    q = f"{E}, {_DEP}, {R}, f0 AS (SELECT root, root AS node, 0 AS depth, 1.0::DOUBLE AS confidence, '' AS way FROM r)"
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT root, node FROM f{j}" for j in range(k))
        q += f""", s{k} AS MATERIALIZED (SELECT root, src AS node, {r6('confidence * conf * 0.9::DOUBLE')} AS confidence, way || '|' || kind || ':' || src AS way, conf FROM f{k - 1} JOIN d ON dst = node),
v{k} AS ({seen}), f{k} AS MATERIALIZED (SELECT root, node, {k} AS depth, arg_min(confidence, way) AS confidence, min(way) AS way FROM s{k} WHERE NOT EXISTS (SELECT 1 FROM v{k} WHERE v{k}.root = s{k}.root AND v{k}.node = s{k}.node) GROUP BY root, node)"""
    q += ", i AS (" + " UNION ALL ".join(f"SELECT root, node, depth, confidence FROM f{k}" for k in range(1, depth + 1)) + ")"
    q += ", low AS (SELECT root, min(conf) AS low FROM (" + " UNION ALL ".join(f"SELECT root, conf FROM s{k}" for k in range(1, depth + 1)) + ") GROUP BY root)"
    return q


@query(f"WITH {_impact_sql(4)} SELECT root, node, depth, confidence FROM i")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on each hub, up to four steps away, with the confidence of the first way found."""
    return g.impact(hub_ids(spark, sf_dir), _dep(spark, sf_dir), Scratch(spark, "impact"))[0]


_RISK = "CASE WHEN direct >= 10 OR transitive >= 50 THEN 'high' WHEN direct >= 3 OR transitive >= 10 THEN 'medium' ELSE 'low' END"


@query(f"""WITH {_impact_sql(4)}, a AS (SELECT root, count(*) FILTER (depth = 1) AS direct, count(*) AS transitive, {r6('avg(confidence)', 4)} AS mean_confidence FROM i WHERE confidence >= 0.3 GROUP BY root)
SELECT root, direct, transitive, mean_confidence, low AS min_edge_confidence, {_RISK} AS risk FROM a JOIN low USING (root)""")
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hub, the dependents whose decayed confidence is at least 0.3, counted anew, and the risk of a change."""
    got, low = g.impact(hub_ids(spark, sf_dir), _dep(spark, sf_dir), Scratch(spark, "impact"))
    a = got.where("confidence >= 0.3").groupBy("root").agg(
        F.count_if(F.col("depth") == 1).alias("direct"), F.count(F.lit(1)).alias("transitive"), half_up(F.avg("confidence"), 4).alias("mean_confidence")
    )
    risk = F.when((F.col("direct") >= 10) | (F.col("transitive") >= 50), "high").when((F.col("direct") >= 3) | (F.col("transitive") >= 10), "medium").otherwise("low")
    return a.join(low, "root").withColumn("risk", risk)


@query(f"""WITH {_impact_sql(4)} SELECT node, min(depth) AS depth, arg_min(confidence, row(depth, -confidence)) AS confidence, count(*) AS n_roots FROM i GROUP BY node""")
def blast_radius_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of all hubs together reaches: per node the least depth, then the greatest confidence, and how many hubs reach it."""
    got, _ = g.impact(hub_ids(spark, sf_dir), _dep(spark, sf_dir), Scratch(spark, "impact"))
    return got.groupBy("node").agg(
        F.min("depth").alias("depth"), F.min_by("confidence", F.struct("depth", -F.col("confidence"))).alias("confidence"), F.count(F.lit(1)).alias("n_roots")
    )


@query(f"""WITH {E}, {_DEP}, {R}, {N}, x AS (SELECT DISTINCT src, dst FROM d WHERE src <> dst), a AS (SELECT root, src AS node, 1 AS d FROM r JOIN x ON dst = root),
b AS (SELECT DISTINCT root, x.src AS node, 2 AS d FROM a JOIN x ON x.dst = a.node WHERE x.src <> root),
m AS (SELECT root, node, min(d) AS d FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT r.root, count(*) FILTER (d = 1) AS direct_count, count(*) FILTER (d = 2) AS depth2_count, count(DISTINCT n.file) AS files FROM r LEFT JOIN m USING (root) LEFT JOIN n ON n.id = m.node GROUP BY 1""")
def hub_summaries_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the hub table as they are now."""
    return g.dependents(hub_ids(spark, sf_dir), _dep(spark, sf_dir), graph_nodes(spark, sf_dir))


@query(f"""WITH RECURSIVE {E}, {R}, x AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), s AS (SELECT src AS root FROM x GROUP BY src ORDER BY count(*) DESC, src LIMIT 30),
o AS (SELECT root FROM s UNION SELECT root FROM r), w AS (SELECT root, root AS node, 0 AS hops FROM o UNION SELECT root, x.dst, hops + 1 FROM w JOIN x ON x.src = w.node WHERE hops < 14),
m AS (SELECT root, node, min(hops) AS hops FROM w GROUP BY 1, 2), g AS (SELECT s.root AS src, r.root AS dst FROM s, r WHERE s.root <> r.root)
SELECT g.src, g.dst, coalesce(f.hops, t.hops) AS hops, CASE WHEN f.hops IS NOT NULL THEN 'forward' WHEN t.hops IS NOT NULL THEN 'reverse' END AS direction
FROM g LEFT JOIN m f ON f.root = g.src AND f.node = g.dst LEFT JOIN m t ON t.root = g.dst AND t.node = g.src""")
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from the 30 nodes with most targets to every hub over edges of all kinds: forward, else in reverse, else null."""
    scratch = Scratch(spark, "paths")
    e = scratch.keep(graph_edges(spark, sf_dir).select("src", "dst").where("src <> dst").distinct(), "pairs")
    hub = hub_ids(spark, sf_dir)
    start = scratch.keep(e.groupBy(F.col("src").alias("root")).count().orderBy(F.desc("count"), "root").limit(30).select("root"), "start")
    d = g.distances(start.union(hub).distinct(), e, scratch)
    # both lists have a fixed number of rows, so have their pairs
    ends = start.select(F.col("root").alias("src"), F.lit(1).alias("k")).join(hub.select(F.col("root").alias("dst"), F.lit(1).alias("k")), "k").where("src <> dst").drop("k")
    ahead = d.select(F.col("root").alias("src"), F.col("node").alias("dst"), F.col("hops").alias("f"))
    back = d.select(F.col("root").alias("dst"), F.col("node").alias("src"), F.col("hops").alias("t"))
    out = ends.join(ahead, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    way = F.when(F.col("f").isNotNull(), "forward").when(F.col("t").isNotNull(), "reverse")
    return out.select("src", "dst", F.coalesce("f", "t").alias("hops"), way.alias("direction"))


@query(f"""WITH RECURSIVE {E}, {R}, x AS (SELECT src, dst FROM e WHERE kind = 'call'), t AS (SELECT DISTINCT src AS root, src AS node, 0 AS depth, [src] AS path FROM x WHERE src NOT IN (SELECT dst FROM x)
UNION ALL SELECT root, x.dst, depth + 1, list_append(path, x.dst) FROM t JOIN x ON x.src = t.node WHERE depth < 3 AND NOT list_contains(path, x.dst))
SELECT root, node, depth, array_to_string(path, '>') AS path FROM t""")
def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways of calls from the entry points (callers that nothing calls), three deep."""
    scratch = Scratch(spark, "tree")
    e = scratch.keep(g.of_kinds(graph_edges(spark, sf_dir), ("call",)), "edges")
    entry = e.select(F.col("src").alias("root")).distinct().join(e.select(F.col("dst").alias("root")), "root", "left_anti")
    t = g.call_tree(entry, e, scratch)
    return t.withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {_impact_sql(4)}, {N}, hit AS (SELECT root, node FROM i UNION SELECT root, root FROM r), t AS (SELECT src AS test, dst FROM e WHERE kind = 'test')
SELECT root, count(DISTINCT test) AS n_tests, count(DISTINCT hit.node) FILTER (n.kind IN ('function', 'method') AND test IS NULL) AS n_untested
FROM hit LEFT JOIN t ON t.dst = hit.node LEFT JOIN n ON n.id = hit.node GROUP BY root""")
def tests_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hub, the distinct tests that cover what a change of it reaches, and the reached functions no test covers."""
    scratch = Scratch(spark, "tests")
    e = scratch.keep(graph_edges(spark, sf_dir), "edges")
    got, _ = g.impact(hub_ids(spark, sf_dir), g.of_kinds(e, g.DEPENDENCY), Scratch(spark, "impact"))
    hit = got.select("root", "node").union(hub_ids(spark, sf_dir).select("root", F.col("root").alias("node"))).distinct()
    t = g.of_kinds(e, ("test",)).select(F.col("src").alias("test"), F.col("dst").alias("node"))
    hit = hit.join(t, "node", "left").join(graph_nodes(spark, sf_dir).select(F.col("id").alias("node"), "kind"), "node", "left")
    bare = F.when(F.col("kind").isin("function", "method") & F.col("test").isNull(), F.col("node"))
    return hit.groupBy("root").agg(F.countDistinct("test").alias("n_tests"), F.countDistinct(bare).alias("n_untested"))


@query(f"""WITH {E}, {_DEP}, {N}, u AS (SELECT src, count(*) AS n_targets, sum(n) AS n_refs FROM d WHERE dst NOT IN (SELECT id FROM n WHERE kind <> 'external') GROUP BY src),
w AS (SELECT dst AS src, count(DISTINCT src) AS dependents FROM d WHERE src <> dst GROUP BY dst)
SELECT src, n_targets, CAST(n_refs AS BIGINT) AS n_refs, coalesce(dependents, 0) AS dependents FROM u LEFT JOIN w USING (src)""")
def unknowns_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with references to targets outside the graph (no node, or an external one): how many, and how many depend on them."""
    d = _dep(spark, sf_dir)
    known = graph_nodes(spark, sf_dir).where("kind <> 'external'").select(F.col("id").alias("dst"))
    u = d.join(known, "dst", "left_anti").groupBy("src").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("n").alias("n_refs"))
    w = d.where("src <> dst").groupBy(F.col("dst").alias("src")).agg(F.countDistinct("src").alias("dependents"))
    return u.join(w, "src", "left").fillna(0, ["dependents"])


@query(f"WITH {E}, {N} SELECT e.src, e.dst, e.kind, n.name, n.file FROM e JOIN n ON n.id = e.dst WHERE e.kind IN ('call', 'references')")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every node calls or refers to; targets that are no nodes are dropped."""
    n = graph_nodes(spark, sf_dir).select(F.col("id").alias("dst"), "name", "file")
    return g.of_kinds(graph_edges(spark, sf_dir), g.USAGE).join(n, "dst").select("src", "dst", "kind", "name", "file")


@query(f"WITH {E}, {N} SELECT e.dst, e.src, e.kind, n.name, n.file FROM e JOIN n ON n.id = e.src WHERE e.kind IN ('call', 'references')")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls or refers to every node."""
    n = graph_nodes(spark, sf_dir).select(F.col("id").alias("src"), "name", "file")
    return g.of_kinds(graph_edges(spark, sf_dir), g.USAGE).join(n, "src").select("dst", "src", "kind", "name", "file")


@query(f"WITH {E}, {R}, x AS (SELECT src AS root, dst AS node FROM e UNION SELECT dst, src FROM e), y AS (SELECT DISTINCT x.root, node FROM x JOIN r USING (root) WHERE node <> x.root) SELECT root, node FROM y QUALIFY row_number() OVER (PARTITION BY root ORDER BY node) <= 50")
def neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 neighbours of every hub, in both directions, each once."""
    e, r = graph_edges(spark, sf_dir), hub_ids(spark, sf_dir)
    both = e.join(r, e.src == r.root).select("root", F.col("dst").alias("node")).union(e.join(r, e.dst == r.root).select("root", F.col("src").alias("node")))
    return g.top_per_key(both.where("root <> node").distinct(), ["root"], ["node"], 50).select("root", "node")


@query(f"""WITH {E}, {N}, x AS (SELECT e.dst, e.src, n.name, count(*) OVER (PARTITION BY e.dst) AS total, row_number() OVER (PARTITION BY e.dst ORDER BY coalesce(importance, 0) DESC, e.src) AS rank
FROM (SELECT DISTINCT src, dst FROM e WHERE kind IN ('call', 'references')) e JOIN n ON n.id = e.src)
SELECT dst, src, name, rank, total > 10 AS more FROM x WHERE rank <= 10""")
def callers_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most important callers of every node, and whether there are more."""
    n = graph_nodes(spark, sf_dir).select(F.col("id").alias("src"), "name", F.coalesce("importance", F.lit(0.0)).alias("w"))
    x = g.of_kinds(graph_edges(spark, sf_dir), g.USAGE).select("src", "dst").distinct().join(n, "src")
    top = g.top_per_key(x, ["dst"], [F.desc("w"), "src"], 10)
    total = x.groupBy("dst").agg(F.count(F.lit(1)).alias("total"))
    return top.join(total, "dst").select("dst", "src", "name", "rank", (F.col("total") > 10).alias("more"))


@query(f"WITH {_LATEST}, {E}, {N} SELECT l.kind, l.src, l.dst, e.conf FROM l LEFT JOIN n ON n.id = l.dst JOIN e ON e.kind = l.kind AND e.src = l.src AND e.dst = l.dst WHERE e.conf >= 0.8 AND {_TIER} = 'observed'")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a confidence of at least 0.8 that were observed."""
    return graph_edges(spark, sf_dir).where("conf >= 0.8").join(epistemic_tier(spark, sf_dir).where("tier = 'observed'"), ["kind", "src", "dst"]).select("kind", "src", "dst", "conf")


@query(f"WITH {N} SELECT id, kind, name, file FROM n WHERE kind NOT IN ('file', 'external') AND (file = 'packages' OR starts_with(file, 'packages/'))")
def scoped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols (no files, no externals) under a path."""
    return graph_nodes(spark, sf_dir).where(~F.col("kind").isin("file", "external") & ((F.col("file") == "packages") | F.col("file").startswith("packages/"))).select("id", "kind", "name", "file")


_SQL_TEST = """(regexp_matches(lower({0}), '(^|/)(__tests__|__test__|tests?|specs?)/') OR regexp_matches(lower(regexp_replace({0}, '^.*/', '')), '\\.(test|spec)\\.[cm]?[jt]sx?$|^test_.*\\.py$|_test\\.(py|go|rb)$|_spec\\.rb$')
 OR regexp_matches(regexp_replace({0}, '^.*/', ''), '[A-Za-z0-9](Test|Tests|IT)\\.java$|[A-Za-z0-9](Test|Tests)\\.(cs|swift)$'))"""


@query(f"""WITH {E}, {N}, tf AS (SELECT file FROM n WHERE {_SQL_TEST.format('file')} UNION SELECT n.file FROM e JOIN n ON n.id = e.src WHERE e.kind = 'test' AND n.file IS NOT NULL)
SELECT DISTINCT a.file AS test_file, e.dst, b.name FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst
WHERE e.kind = 'call' AND a.file IN (SELECT file FROM tf) AND b.file IS NOT NULL AND b.file NOT IN (SELECT file FROM tf) AND b.kind <> 'external'""")
def test_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test edges that follow from the structure: calls out of test files into product code.

    Test files are those named by convention and those a ``test`` edge comes from."""
    n, e = graph_nodes(spark, sf_dir).where("file is not null"), graph_edges(spark, sf_dir)
    sources = g.of_kinds(e, ("test",)).select(F.col("src").alias("id")).distinct()
    tests = n.where(is_test_file(F.col("file"))).select("file").union(n.join(sources, "id", "left_semi").select("file")).distinct()
    a = n.join(tests, "file", "left_semi").select(F.col("id").alias("src"), F.col("file").alias("test_file"))
    b = n.join(tests, "file", "left_anti").where("kind <> 'external'").select(F.col("id").alias("dst"), "name")
    return g.of_kinds(e, ("call",)).join(a, "src").join(b, "dst").select("test_file", "dst", "name").distinct()


@query(f"""WITH {E}, {N}, t AS (SELECT DISTINCT dst, src FROM e WHERE kind = 'test') SELECT n.id, t.src AS test, CASE WHEN t.src IS NULL THEN 'coverage' ELSE 'test' END AS via
FROM n LEFT JOIN t ON t.dst = n.id WHERE t.src IS NOT NULL OR n.tested""")
def covering_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of every node; a node that only coverage shows as tested has one row without a test."""
    t = g.of_kinds(graph_edges(spark, sf_dir), ("test",)).select(F.col("dst").alias("id"), F.col("src").alias("test")).distinct()
    n = graph_nodes(spark, sf_dir).select("id", "tested").join(t, "id", "left").where("test is not null or tested")
    return n.select("id", "test", F.when(F.col("test").isNull(), "coverage").otherwise("test").alias("via"))


@query(f"""WITH {E}, {_DEP}, {N}, x AS (SELECT d.src, d.dst, a.repository_id AS a, b.repository_id AS b, d.conf FROM d JOIN n a ON a.id = d.src JOIN n b ON b.id = d.dst WHERE a.repository_id <> b.repository_id)
SELECT a AS from_repository, b AS to_repository, count(*) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets, max(conf) AS conf FROM x GROUP BY 1, 2""")
def workspace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies between repositories."""
    n = graph_nodes(spark, sf_dir).select("id", "repository_id")
    x = _dep(spark, sf_dir).join(n.select(F.col("id").alias("src"), F.col("repository_id").alias("from_repository")), "src").join(n.select(F.col("id").alias("dst"), F.col("repository_id").alias("to_repository")), "dst")
    return x.where("from_repository <> to_repository").groupBy("from_repository", "to_repository").agg(
        F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"), F.max("conf").alias("conf")
    )


@query(f"""WITH {_impact_sql(4)}, {N}, h AS (SELECT i.root, count(*) AS home FROM i JOIN n a ON a.id = i.root JOIN n b ON b.id = i.node WHERE a.repository_id = b.repository_id GROUP BY 1),
x AS (SELECT i.root, b.repository_id, i.node, i.depth, row_number() OVER (PARTITION BY i.root, b.repository_id ORDER BY i.depth, i.confidence DESC, i.node) AS rank FROM i JOIN n a ON a.id = i.root JOIN n b ON b.id = i.node WHERE a.repository_id <> b.repository_id AND i.confidence >= 0.3)
SELECT root, repository_id, node, depth, rank FROM x WHERE rank <= 10""")
def cross_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest dependents of every hub in each other repository."""
    got, _ = g.impact(hub_ids(spark, sf_dir), _dep(spark, sf_dir), Scratch(spark, "impact"))
    n = graph_nodes(spark, sf_dir).select("id", "repository_id")
    x = got.where("confidence >= 0.3").join(n.select(F.col("id").alias("root"), F.col("repository_id").alias("home")), "root").join(n.select(F.col("id").alias("node"), "repository_id"), "node")
    return g.top_per_key(x.where("home <> repository_id"), ["root", "repository_id"], ["depth", F.desc("confidence"), "node"], 10).select("root", "repository_id", "node", "depth", "rank")


@query(f"""WITH {E}, {N} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(DISTINCT file) FROM n) AS n_files, (SELECT count(DISTINCT area) FROM n) AS n_areas,
(SELECT count(*) FROM n WHERE tested) AS n_tested, (SELECT CAST(sum(n) AS BIGINT) FROM e) AS n_rows""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the whole graph in one row."""
    n = graph_nodes(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file").alias("n_files"), F.countDistinct("area").alias("n_areas"), F.count_if("tested").alias("n_tested")
    )
    return n.join(graph_edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("n").alias("n_rows")))


_LAYER = "CASE WHEN regexp_matches({0}, '(^|/)(route|api|ui|view|page)[^/]*/') THEN 3 WHEN regexp_matches({0}, '(^|/)(engine|model|core|util|config|storage|parsers)[^/]*/') THEN 1 ELSE 2 END"


@query(f"""WITH {E}, {_DEP}, {N}, x AS (SELECT d.src, d.dst, {_LAYER.format('a.file')} AS from_layer, {_LAYER.format('b.file')} AS to_layer, conf FROM d JOIN n a ON a.id = d.src JOIN n b ON b.id = d.dst WHERE a.file IS NOT NULL AND b.file IS NOT NULL)
SELECT src, dst, from_layer, to_layer, max(conf) AS conf FROM x WHERE from_layer < to_layer GROUP BY 1, 2, 3, 4""")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies that lead from a lower layer of the code up to a higher one."""

    def layer(f):
        return F.when(f.rlike("(^|/)(route|api|ui|view|page)[^/]*/"), 3).when(f.rlike("(^|/)(engine|model|core|util|config|storage|parsers)[^/]*/"), 1).otherwise(2)

    n = graph_nodes(spark, sf_dir).where("file is not null").select("id", layer(F.col("file")).alias("layer"))
    x = _dep(spark, sf_dir).join(n.select(F.col("id").alias("src"), F.col("layer").alias("from_layer")), "src").join(n.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    return x.where("from_layer < to_layer").groupBy("src", "dst", "from_layer", "to_layer").agg(F.max("conf").alias("conf"))


@query(f"""WITH {E}, x AS (SELECT sha256(kind || '|' || src || '|' || dst || '|' || n) AS h FROM e)
SELECT count(*) AS n_rows, sha256(concat_ws(',', {', '.join(f"(sum(('0x' || substr(h, {1 + 13 * i}, 13))::BIGINT))::VARCHAR" for i in range(4))})) AS digest FROM x""")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of all collapsed edges that depends neither on their order nor on the partitioning: sums of the rows' hashes, hashed."""
    h = graph_edges(spark, sf_dir).select(F.sha2(F.concat_ws("|", "kind", "src", "dst", F.col("n").cast("string")), 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 13 * i, 13), 16, 10).cast("decimal(30,0)")).cast("string") for i in range(4)]
    return h.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws(",", *sums), 256).alias("digest"))
