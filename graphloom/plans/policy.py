"""Queries of predicates, policies and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.paths import directory
from graphloom.functions.versions import upgrade_window, version
from graphloom.operators import centrality, graph as g
from graphloom.operators.joins import snapshot_diff
from graphloom.plans.resolve import _DIR, F_SQL, M_SQL, module_resolution
from graphloom.plans.resolve import _package_versions, _v
from graphloom.plans.retrieval import _symbols
from graphloom.plans.views import DEP_SQL, E, N, graph_edges, graph_nodes, r6
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


_RULES = ((1, "log", "go"), (2, "FMT", None), (3, "std", "rs"), (4, "log", None), (5, "set", None))


@query(f"""WITH {F_SQL}, {M_SQL}, u AS (SELECT DISTINCT spec, lower(regexp_extract(rel, '\\.([A-Za-z0-9]+)$', 1)) AS eco FROM mr WHERE how = 'external'), r AS (SELECT * FROM (VALUES {', '.join(f"({a}, '{b}', {repr(c) if c else 'NULL'})" for a, b, c in _RULES)}) r(nr, name, eco))
SELECT u.spec AS package, u.eco AS ecosystem, min(nr) AS rule FROM u JOIN r ON lower(u.spec) = lower(r.name) AND (r.eco IS NULL OR r.eco = u.eco) GROUP BY 1, 2""")
def banned_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages in use that a list of rules bans, in any case, for one ecosystem or all; the first rule wins."""
    rules = spark.createDataFrame(list(_RULES), "nr int, name string, eco string").withColumn("key", F.lower("name"))
    u = module_resolution(spark, sf_dir).where("how = 'external'").select("spec", F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1)).alias("ecosystem")).distinct()
    hit = u.join(F.broadcast(rules), F.lower("spec") == F.col("key")).where(F.col("eco").isNull() | (F.col("eco") == F.col("ecosystem")))
    return hit.groupBy(F.col("spec").alias("package"), "ecosystem").agg(F.min("nr").alias("rule"))


@query(f"""WITH dp AS (SELECT DISTINCT l_partkey AS package, l_suppkey % 50 || '.' || l_linenumber || '.' || CAST(l_quantity AS INT) AS v FROM lineitem) SELECT package, v AS version FROM (SELECT *, {_v('v')} AS p FROM dp) WHERE p[1] * 1000000 + p[2] * 1000 + p[3] > 10002000 AND p[1] * 1000000 + p[2] * 1000 + p[3] <= 14000000""")
def upgrade_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of every package above one version, up to another."""
    a, b = version(F.lit("10.2")), version(F.lit("14.0.0"))
    return _package_versions(spark, sf_dir).where(upgrade_window(F.col("v"), a, b)).select("package", F.col("text").alias("version"))


_EXPRS = ("MIT", "Apache-2.0 OR GPL-3.0-only", "GPL-2.0-or-later WITH Classpath-exception-2.0", "MIT AND LGPL-2.1", "LicenseRef-x", "(BSD-3-Clause OR MIT) AND ISC", "MPL-2.0+")
_RISKS = ("low", "low", "high", "medium", "unknown", "low", "medium")


@query("SELECT p_partkey, " + "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_RISKS)) + " END AS risk FROM part")
def licence_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk of a licence expression given to every part."""
    expr = F.get(F.array(*map(F.lit, _EXPRS)), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.licence_risk(expr).alias("risk"))


@query(f"WITH {N}, k AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY file, id) AS r, count(*) OVER (PARTITION BY name) AS c FROM n WHERE name IS NOT NULL) SELECT name, c AS n_candidates, max(CASE WHEN r = 2 THEN id END) AS second, CASE WHEN c = 1 THEN max(id) END AS only FROM k GROUP BY 1, 2")
def pick_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per name: how many nodes bear it, the second by file, and the one meant without a pick (null where ambiguous)."""
    n = graph_nodes(spark, sf_dir).where("name is not null").select("name", "file", "id")
    c = n.groupBy("name").agg(F.count(F.lit(1)).alias("n_candidates"), F.max("id").alias("any"))
    second = g.top_per_key(n, ["name"], [F.asc_nulls_last("file"), "id"], 2).where("rank = 2").select("name", F.col("id").alias("second"))
    return c.join(second, "name", "left").select("name", "n_candidates", "second", F.when(F.col("n_candidates") == 1, F.col("any")).alias("only"))


@query("SELECT DISTINCT lib_id FROM lib_entries WHERE added_at IS NULL OR TIMESTAMPTZ '2026-05-01 12:00:00+00' <= date_trunc('day', added_at) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND")
def active_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that still hold on a stated day: through the whole day they name, or for ever without one."""
    until = F.date_trunc("day", "added_at") + F.expr("interval 1 day") - F.expr("interval 1 millisecond")
    return table(spark, sf_dir, "lib_entries").where(F.col("added_at").isNull() | (F.lit("2026-05-01 12:00:00").cast("timestamp") <= until)).select("lib_id").distinct()


@query(f"""WITH {E}, {N}, x AS (SELECT e.kind, src, dst, least(a.area, b.area) AS a, greatest(a.area, b.area) AS b, e.kind = 'import' AND (b.kind = 'external' OR a.kind = 'external') AS frame FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.area <> b.area AND e.kind IN {DEP_SQL}),
s AS (SELECT *, {r6('1.0::DOUBLE / count(*) OVER (PARTITION BY a, b)')} AS surprise FROM x) SELECT kind, src, dst, surprise FROM s WHERE NOT frame ORDER BY surprise DESC, kind, src, dst LIMIT 50""")
def oddities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 rarest links between areas, imports of external packages left out."""
    n = graph_nodes(spark, sf_dir)
    s = g.surprise(g.of_kinds(graph_edges(spark, sf_dir), g.DEPENDENCY), n)
    ext = n.where("kind = 'external'").select("id")
    frame = s.where("kind = 'import'").join(ext.withColumnRenamed("id", "dst"), "dst", "left_semi").union(s.where("kind = 'import'").join(ext.withColumnRenamed("id", "src"), "src", "left_semi").select("dst", "kind", "src", "surprise"))
    return s.join(frame.select("kind", "src", "dst"), ["kind", "src", "dst"], "left_anti").orderBy(F.desc("surprise"), "kind", "src", "dst").limit(50)


_ROLES = (("test", r"(^|/)(tests?|spec)/|[._](test|spec)\."), ("config", r"(^|/)(config|settings)(/|\.)|\.(ya?ml|toml|json)$"), ("ui", r"(^|/)(web|client|ui|view)/"), ("server", r"(^|/)(server|api|routes?)/"), ("storage", r"(^|/)(storage|db|model)/"), ("util", r"(^|/)(util|lib|shared)/"))


@query(f"WITH {N}, r AS (SELECT id, CASE " + " ".join(f"WHEN regexp_matches(file, '{rx}') THEN '{k}'" for k, rx in _ROLES) + " ELSE 'core' END AS role FROM n WHERE file IS NOT NULL) SELECT role, count(*) AS n FROM r GROUP BY 1")
def code_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by the role their path gives them, first rule first."""
    role = F.lit("core")
    for k, rx in reversed(_ROLES):
        role = F.when(F.col("file").rlike(rx), k).otherwise(role)
    return graph_nodes(spark, sf_dir).where("file is not null").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"))


_ASKED = ("platform/engine", "packages/report", "platform/util/token")


@query(f"WITH {N}, d AS (SELECT id, string_split({_DIR.format('file')}, '/') AS p FROM n WHERE file IS NOT NULL), x AS (SELECT id, " + "greatest(" + ", ".join(f"len(list_filter(generate_series(1, least(len(p), {a.count('/') + 1})), lambda i: p[1:i] = string_split('{a}', '/')[1:i]))" for a in _ASKED) + f") AS depth FROM d) SELECT id, depth, {r6('1 + 0.3 * least(depth / 2, 1)', 4)} AS boost FROM x WHERE depth > 0")
def topic_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep the directories of every node agree with one of the asked paths, and what that adds to a score."""
    from graphloom.functions.numbers import half_up

    p = F.split(directory(F.col("file")), "/")

    def depth(a: str):
        q = F.split(F.lit(a), "/")
        return F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(p), F.size(q))), lambda i: F.slice(p, F.lit(1), i) == F.slice(q, F.lit(1), i)))

    x = graph_nodes(spark, sf_dir).where("file is not null").select("id", F.greatest(*map(depth, _ASKED)).cast("long").alias("depth")).where("depth > 0")
    return x.withColumn("boost", half_up(1 + 0.3 * F.least(F.col("depth") / 2, F.lit(1.0)), 4))


def _symbols_at(spark: SparkSession, sf_dir: str, last: bool) -> DataFrame:
    t = table(spark, sf_dir, "cache_entries").where("parse is not null and repository_id is not null and rel is not null and cached_at is not null")
    pick = F.max_by if last else F.min_by
    x = t.groupBy("repository_id", "rel").agg(pick("parse", F.struct("cached_at", F.coalesce("hash", F.lit("")))).alias("p"))
    d = x.select("repository_id", "rel", F.explode("p.defs").alias("d"))
    return d.groupBy("repository_id", "rel", F.col("d.qualified_name").alias("qname")).agg(F.min("d.signature").alias("signature")).where("qname is not null")


def _sym(agg: str) -> str:
    return f"(SELECT repository_id, rel, d.qualified_name AS qname, min(d.signature) AS signature FROM (SELECT repository_id, rel, unnest(p.defs) AS d FROM (SELECT repository_id, rel, {agg}(parse, row(cached_at, coalesce(hash, ''))) AS p FROM cache_entries WHERE parse IS NOT NULL AND repository_id IS NOT NULL AND rel IS NOT NULL AND cached_at IS NOT NULL GROUP BY 1, 2)) WHERE d.qualified_name IS NOT NULL GROUP BY 1, 2, 3)"


@query(f"""WITH a AS {_sym('arg_min')}, b AS {_sym('arg_max')} SELECT repository_id, rel, qname, CASE WHEN a.qname IS NULL THEN 'added' WHEN b.qname IS NULL THEN 'removed' WHEN a.signature IS NOT DISTINCT FROM b.signature THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (repository_id, rel, qname)""")
def capsule_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of every file at its first parse against its last."""
    d = snapshot_diff(_symbols_at(spark, sf_dir, False), _symbols_at(spark, sf_dir, True), ["repository_id", "rel", "qname"], "signature")
    return d.select("repository_id", "rel", "qname", "status")


def area_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each area lies on the shortest ways between others: Brandes' algorithm, its sources spread over the tasks."""
    n = graph_nodes(spark, sf_dir).where("area is not null").select("id", F.col("area").cast("string").alias("area"))
    pairs = g.contract(g.of_kinds(graph_edges(spark, sf_dir), g.DEPENDENCY), n, "area").select("src", "dst").distinct()
    return centrality.betweenness(n.select(F.col("area").alias("id")).distinct(), pairs, Scratch(spark, "betweenness"))


QUERIES["area_betweenness"] = area_betweenness


@query(f"""WITH RECURSIVE {F_SQL}, {M_SQL}, h AS (SELECT repo, rel, sha256(to_json(parse.imports)::VARCHAR || len(parse.defs)) AS h FROM f WHERE parse.imports IS NOT NULL AND parse.defs IS NOT NULL), e AS (SELECT DISTINCT repo, rel, target FROM mr WHERE target IS NOT NULL AND target <> rel),
w AS (SELECT repo, rel AS root, rel AS node FROM h UNION SELECT w.repo, w.root, e.target FROM w JOIN e ON e.repo = w.repo AND e.rel = w.node)
SELECT w.repo, w.root AS rel, count(*) AS n_files FROM w JOIN h ON h.repo = w.repo AND h.rel = w.node GROUP BY 1, 2""")
def invalidation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file, how many files it reaches over its imports, itself included: a change in any of them makes its cached result stale."""
    from graphloom.plans.resolve import parses

    h = parses(spark, sf_dir).where("parse.imports is not null and parse.defs is not null").select(F.concat_ws("\x1f", "repo", "rel").alias("root"))
    m = module_resolution(spark, sf_dir).where("target is not null and target <> rel")
    e = m.select(F.concat_ws("\x1f", "repo", "rel").alias("src"), F.concat_ws("\x1f", "repo", "target").alias("dst"))
    d = g.distances(h, e, Scratch(spark, "scope")).join(h.select(F.col("root").alias("node")), "node", "left_semi")
    k = F.split("root", "\x1f")
    return d.groupBy("root").agg(F.count(F.lit(1)).alias("n_files")).select(F.get(k, F.lit(0)).alias("repo"), F.get(k, F.lit(1)).alias("rel"), "n_files")


@query(f"""WITH {N}, s AS (SELECT 'symbol' AS hit, id AS ref, 0 AS line FROM n WHERE kind NOT IN ('file', 'external') AND contains(lower(name), 'ledger') ORDER BY length(name), id LIMIT 10),
d AS (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1), l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS s, generate_subscripts(string_split(text, E'\\n'), 1) AS line FROM d), t AS (SELECT 'text' AS hit, CAST(doc_id AS VARCHAR) AS ref, line FROM l WHERE contains(lower(s), 'ledger') ORDER BY doc_id, line LIMIT 20)
SELECT * FROM s UNION ALL SELECT * FROM t""")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase among the symbols (a third of the list) and in the texts (the rest)."""
    from graphloom.operators.retrieval import literal_scan

    low = F.lower("name")
    s = _symbols(spark, sf_dir).where(low.contains("ledger")).orderBy(F.length("name"), "id").limit(10).select(F.lit("symbol").alias("hit"), F.col("id").alias("ref"), F.lit(0).cast("long").alias("line"))
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    t = literal_scan(d, "text", ("ledger",), ["doc_id"]).orderBy("doc_id", "line").limit(20)
    return s.union(t.select(F.lit("text"), F.col("doc_id").cast("string"), F.col("line").cast("long")))


@query(f"""WITH {F_SQL}, {M_SQL}, l AS (SELECT DISTINCT repository_id AS repo, lib_name, string_split(lower(lib_name), '-')[1] AS top FROM lib_entries WHERE lib_name IS NOT NULL AND repository_id IS NOT NULL)
SELECT l.repo, l.lib_name, count(DISTINCT mr.rel) AS n_files FROM l JOIN mr ON mr.repo = l.repo AND mr.how = 'external' AND string_split(lower(regexp_replace(mr.spec, '[_.]+', '-', 'g')), '-')[1] = l.top GROUP BY 1, 2""")
def import_package_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries with the files that import something of the same first segment, names normalised: a derived key, not a comparison of all."""
    l = table(spark, sf_dir, "lib_entries").where("lib_name is not null and repository_id is not null").select(F.col("repository_id").alias("repo"), "lib_name", F.substring_index(F.lower("lib_name"), "-", 1).alias("top")).distinct()
    m = module_resolution(spark, sf_dir).where("how = 'external'").select("repo", "rel", F.substring_index(tx.normal_package(F.col("spec")), "-", 1).alias("top")).distinct()
    return l.join(m, ["repo", "top"]).groupBy("repo", "lib_name").agg(F.countDistinct("rel").alias("n_files"))


@query(f"""WITH {N} SELECT kind, lang, visibility, count(*) AS n, CAST(sum(CAST(round(importance * 10000) AS BIGINT)) AS BIGINT) AS importance_e4, max(importance) AS most FROM n GROUP BY CUBE (kind, lang, visibility)""")
def node_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, their summed importance (in ten-thousandths) and the greatest one by kind, language and visibility in every combination."""
    w = F.round(F.col("importance") * 10000).cast("long")
    return graph_nodes(spark, sf_dir).cube("kind", "lang", "visibility").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("importance_e4"), F.max("importance").alias("most"))
