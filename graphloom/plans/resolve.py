"""Queries of the join family: parse facts, libraries and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import clean
from graphloom.functions.numbers import half_up
from graphloom.functions.versions import jump, majors_between, range_kind, version
from graphloom.operators import graph as g
from graphloom.operators import joins as j
from graphloom.plans.views import DEP_SQL, E, N, c, graph_edges, graph_nodes, r6
from graphloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, rel, parse): the latest cache entry of every file that has facts; ties go to the greatest hash."""
    t = table(spark, sf_dir, "cache_entries").where("parse is not null and repository_id is not null and rel is not null and cached_at is not null")
    t = t.select(F.col("repository_id").alias("repo"), "rel", "parse", "cached_at", F.coalesce("hash", F.lit("")).alias("h"))
    return j.latest(t, ["repo", "rel"], ["cached_at", "h"], ["parse"])


def defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parses(spark, sf_dir).select("repo", "rel", F.posexplode("parse.defs").alias("ord", "d"))
    return d.select("repo", "rel", "ord", "d.kind", F.col("d.node_name").alias("name"), F.col("d.qualified_name").alias("qname"), "d.start_line", "d.end_line", "d.visibility")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parses(spark, sf_dir).select("repo", "rel", F.posexplode("parse.calls").alias("ord", "d"))
    return d.select("repo", "rel", "ord", "d.callee", "d.line", "d.qualified")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parses(spark, sf_dir).select("repo", "rel", F.explode("parse.imports").alias("spec"))


F_SQL = """f AS (SELECT repository_id AS repo, rel, arg_max(parse, row(cached_at, coalesce(hash, ''))) AS parse FROM cache_entries WHERE parse IS NOT NULL AND repository_id IS NOT NULL AND rel IS NOT NULL AND cached_at IS NOT NULL GROUP BY 1, 2),
df AS (SELECT repo, rel, ord, d.kind, d.node_name AS name, d.qualified_name AS qname, d.start_line, d.end_line, d.visibility FROM (SELECT repo, rel, unnest(parse.defs) AS d, generate_subscripts(parse.defs, 1) - 1 AS ord FROM f)),
cl AS (SELECT repo, rel, ord, d.callee, d.line, d.qualified FROM (SELECT repo, rel, unnest(parse.calls) AS d, generate_subscripts(parse.calls, 1) - 1 AS ord FROM f)),
im AS (SELECT DISTINCT repo, rel, spec FROM (SELECT repo, rel, unnest(parse.imports) AS spec FROM f) WHERE spec IS NOT NULL AND spec <> '')"""


@query(f"""WITH {F_SQL}, h AS (SELECT cl.repo, cl.rel, cl.ord, arg_min(row(df.ord, df.name), row(df.end_line - df.start_line, df.ord)) AS b FROM cl JOIN df ON cl.repo = df.repo AND cl.rel = df.rel AND df.start_line <= cl.line AND cl.line <= df.end_line GROUP BY 1, 2, 3)
SELECT cl.repo, cl.rel, cl.ord, cl.callee, cl.line, b[1] AS def_ord, b[2] AS def_name FROM cl LEFT JOIN h ON cl.repo = h.repo AND cl.rel = h.rel AND cl.ord = h.ord""")
def interval_join_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with the smallest definition around it."""
    p = calls(spark, sf_dir).withColumn("point_id", F.struct("repo", "rel", "ord"))
    d = defs(spark, sf_dir).select("repo", "rel", "start_line", "end_line", F.col("ord").alias("def_ord"), F.col("name").alias("def_name"))
    out = j.enclosing(p, d, ["repo", "rel"], "line", "start_line", "end_line", ["def_ord", "def_name"], "def_ord")
    return out.select("repo", "rel", "ord", "callee", "line", "def_ord", "def_name")


@query(f"""WITH {F_SQL}, gd AS (SELECT repo, rel, ord, d.expr, d.line FROM (SELECT repo, rel, unnest(parse.guards) AS d, generate_subscripts(parse.guards, 1) - 1 AS ord FROM f)),
st AS (SELECT gd.repo, gd.rel, gd.ord, min(df.ord) AS ord2 FROM gd JOIN df ON gd.repo = df.repo AND gd.rel = df.rel AND gd.line = df.start_line GROUP BY 1, 2, 3),
en AS (SELECT gd.repo, gd.rel, gd.ord, arg_min(df.ord, row(df.end_line - df.start_line, df.ord)) AS ord2 FROM gd JOIN df ON gd.repo = df.repo AND gd.rel = df.rel AND df.start_line <= gd.line AND gd.line <= df.end_line GROUP BY 1, 2, 3)
SELECT gd.repo, gd.rel, gd.ord, gd.line, coalesce(st.ord2, en.ord2) AS def_ord, CASE WHEN st.ord2 IS NOT NULL THEN 'start' WHEN en.ord2 IS NOT NULL THEN 'inside' ELSE 'file' END AS how, md5(gd.expr) AS expr
FROM gd LEFT JOIN st USING (repo, rel, ord) LEFT JOIN en USING (repo, rel, ord)""")
def node_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every guard with the definition that starts at its line, else the smallest around it, else its file."""
    gd = parses(spark, sf_dir).select("repo", "rel", F.posexplode("parse.guards").alias("ord", "d")).select("repo", "rel", "ord", F.col("d.line").alias("line"), F.md5(F.col("d.expr").cast("binary")).alias("expr"))
    p = gd.withColumn("point_id", F.struct("repo", "rel", "ord"))
    d = defs(spark, sf_dir).select("repo", "rel", "start_line", "end_line", F.col("ord").alias("inside"))
    inner = j.enclosing(p, d, ["repo", "rel"], "line", "start_line", "end_line", ["inside"], "inside")
    first = d.groupBy("repo", "rel", F.col("start_line").alias("line")).agg(F.min("inside").alias("starts"))
    out = inner.join(first, ["repo", "rel", "line"], "left")
    how = F.when(F.col("starts").isNotNull(), "start").when(F.col("inside").isNotNull(), "inside").otherwise("file")
    return out.select("repo", "rel", "ord", "line", F.coalesce("starts", "inside").alias("def_ord"), how.alias("how"), "expr")


_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"
_STEM = "regexp_replace({0}, '\\.[A-Za-z0-9]+$', '')"
M_SQL = f"""fs AS (SELECT DISTINCT repo, rel AS target, {_STEM.format('rel')} AS stem FROM f),
nr AS (SELECT repo, rel, spec, array_to_string(list_filter(string_split(concat_ws('/', nullif({_DIR.format('rel')}, ''), spec), '/'), lambda x: x <> '' AND x <> '.'), '/') AS want FROM im WHERE regexp_matches(spec, '^\\./')),
rl AS (SELECT nr.repo, nr.rel, spec, arg_min(target, row(target <> want, target)) AS target, 'relative' AS how FROM nr JOIN fs ON nr.repo = fs.repo AND regexp_replace(want, '\\.(js|ts|mjs|jsx|tsx)$', '') = stem GROUP BY 1, 2, 3),
tl AS (SELECT repo, target, array_to_string(p[k:], '/') AS tail FROM (SELECT repo, target, string_split(stem, '/') AS p, unnest(generate_series(1, len(string_split(stem, '/')))) AS k FROM fs)),
sx AS (SELECT im.repo, im.rel, spec, target, string_split({_DIR.format('im.rel')}, '/') AS a, string_split({_DIR.format('target')}, '/') AS b FROM im JOIN tl ON im.repo = tl.repo AND regexp_replace(spec, '[.:]+', '/', 'g') = tail WHERE NOT regexp_matches(spec, '^\\.\\.?/') AND target <> im.rel),
sf AS (SELECT repo, rel, spec, arg_min(target, row(-len(list_filter(generate_series(1, least(len(a), len(b))), lambda k: a[1:k] = b[1:k])), target)) AS target, 'suffix' AS how FROM sx GROUP BY 1, 2, 3),
mr AS (SELECT im.*, x.target, coalesce(x.how, 'external') AS how FROM im LEFT JOIN (SELECT * FROM rl UNION ALL SELECT * FROM sf) x USING (repo, rel, spec))"""


@query(f"WITH {F_SQL}, {M_SQL} SELECT repo, rel, spec, target, how FROM mr")
def module_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every import with the file of its repository it means, or external."""
    return j.resolve_modules(imports(spark, sf_dir), parses(spark, sf_dir).select("repo", "rel"))


@query(f"""WITH {F_SQL}, {M_SQL} SELECT repo, spec AS package, count(*) AS n_files FROM mr WHERE how = 'external' GROUP BY 1, 2""")
def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages outside each repository that its files import."""
    m = module_resolution(spark, sf_dir).where("how = 'external'")
    return m.groupBy("repo", F.col("spec").alias("package")).agg(F.count(F.lit(1)).alias("n_files"))


@query(f"""WITH {F_SQL}, {M_SQL}, hr AS (SELECT cl.repo, cl.rel, cl.ord, cl.callee, count(*) AS k, min(df.ord) AS target_ord FROM cl JOIN df ON cl.repo = df.repo AND cl.rel = df.rel AND cl.callee = df.name GROUP BY 1, 2, 3, 4),
rc AS (SELECT DISTINCT repo, rel, target AS target_rel FROM mr WHERE target IS NOT NULL AND target <> rel),
fr AS (SELECT cl.repo, cl.rel, cl.ord, cl.callee, min(df.rel) AS target_rel, min(df.ord) AS target_ord FROM cl JOIN rc ON cl.repo = rc.repo AND cl.rel = rc.rel JOIN df ON df.repo = cl.repo AND df.rel = rc.target_rel AND df.name = cl.callee
  WHERE NOT EXISTS (SELECT 1 FROM hr WHERE hr.repo = cl.repo AND hr.rel = cl.rel AND hr.ord = cl.ord) GROUP BY 1, 2, 3, 4 HAVING count(*) = 1)
SELECT cl.repo, cl.rel, cl.ord, cl.callee, coalesce(CASE WHEN hr.k IS NOT NULL THEN hr.rel END, fr.target_rel) AS target_rel, coalesce(hr.target_ord, fr.target_ord) AS target_ord,
CASE WHEN hr.k = 1 THEN 0.85::DOUBLE WHEN hr.k > 1 THEN 0.4::DOUBLE WHEN fr.target_rel IS NOT NULL THEN 0.75::DOUBLE END AS confidence, CASE WHEN hr.k = 1 THEN 'file' WHEN hr.k > 1 THEN 'file-first' WHEN fr.target_rel IS NOT NULL THEN 'reach' END AS rung
FROM cl LEFT JOIN hr ON hr.repo = cl.repo AND hr.rel = cl.rel AND hr.ord = cl.ord LEFT JOIN fr ON fr.repo = cl.repo AND fr.rel = cl.rel AND fr.ord = cl.ord WHERE cl.callee IS NOT NULL""")
def resolve_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with its definition by the ladder, or unresolved."""
    m = module_resolution(spark, sf_dir)
    return j.resolve_calls(calls(spark, sf_dir).where("callee is not null"), defs(spark, sf_dir), m.select("repo", "rel", "target"))


@query(f"""WITH {F_SQL}, ty AS (SELECT DISTINCT repo, rel, callee AS spec FROM cl WHERE callee IS NOT NULL),
k AS (SELECT ty.repo, ty.rel, ty.spec, CASE WHEN df.rel = ty.rel THEN 1 WHEN {_DIR.format('df.rel')} = {_DIR.format('ty.rel')} THEN 2 ELSE 3 END AS rung, df.rel AS target, df.ord FROM ty JOIN df ON df.repo = ty.repo AND df.name = ty.spec),
b AS (SELECT repo, rel, spec, rung, count(*) AS c, min(target) AS target FROM k GROUP BY 1, 2, 3, 4), m AS (SELECT repo, rel, spec, min(rung) AS rung FROM b GROUP BY 1, 2, 3)
SELECT repo, rel, spec AS name, rung, target FROM b JOIN m USING (repo, rel, spec, rung) WHERE c = 1""")
def type_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that files use with the definition they mean: in the file, else in its directory, else in the repository; only where unique."""
    words = calls(spark, sf_dir).where("callee is not null").select("repo", "rel", F.col("callee").alias("name")).distinct()
    d = defs(spark, sf_dir).select("repo", F.col("rel").alias("target"), "name")
    from graphloom.functions.paths import directory

    rung = F.when(F.col("target") == F.col("rel"), 1).when(directory(F.col("target")) == directory(F.col("rel")), 2).otherwise(3)
    b = words.join(d, ["repo", "name"]).groupBy("repo", "rel", "name", rung.alias("rung")).agg(F.count(F.lit(1)).alias("c"), F.min("target").alias("target"))
    best = b.groupBy("repo", "rel", "name").agg(F.min_by(F.struct("rung", "c", "target"), "rung").alias("x")).where("x.c = 1")
    return best.select("repo", "rel", "name", "x.rung", "x.target")


@query(f"""WITH {F_SQL}, ns AS (SELECT DISTINCT repo, rel, regexp_extract(qname, '^(.*)[.#:]+[^.#:]+$', 1) AS space FROM df WHERE regexp_matches(qname, '[.#:]')), u AS (SELECT repo, rel, space FROM ns WHERE space <> '')
SELECT repo, space, count(DISTINCT rel) AS n_files, min(rel) AS first_file FROM u GROUP BY 1, 2""")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The namespaces (what stands before a qualified name's last part) of every repository and the files that share them."""
    d = defs(spark, sf_dir).where(F.col("qname").rlike("[.#:]")).select("repo", "rel", F.regexp_extract("qname", "^(.*)[.#:]+[^.#:]+$", 1).alias("space")).where("space <> ''").distinct()
    return d.groupBy("repo", "space").agg(F.countDistinct("rel").alias("n_files"), F.min("rel").alias("first_file"))


_RES = f"""er AS (SELECT {c('kind')} AS kind, {c('src')} AS src, {c('dst')} AS dst, resolution, coalesce(max(confidence), 0.5) AS conf FROM edges WHERE {c('kind')} IN {DEP_SQL} AND {c('src')} <> '' AND {c('dst')} <> '' GROUP BY 1, 2, 3, 4),
hu AS (SELECT kind, src, dst, max(conf) AS conf FROM er WHERE resolution = 'heuristic' GROUP BY 1, 2, 3), pr AS (SELECT kind, src, dst, max(conf) AS conf FROM er WHERE resolution = 'scip' GROUP BY 1, 2, 3)"""


@query(f"""WITH {_RES}, {N}, cv AS (SELECT DISTINCT n.file FROM pr JOIN n ON n.id = pr.src WHERE n.file IS NOT NULL), kp AS (SELECT hu.* FROM hu LEFT JOIN n ON n.id = hu.src WHERE n.file IS NULL OR n.file NOT IN (SELECT file FROM cv))
SELECT kind, src, dst, conf, true AS precise FROM pr UNION ALL SELECT kind, src, dst, conf, false FROM kp WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.kind = kp.kind AND pr.src = kp.src AND pr.dst = kp.dst)""")
def merge_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies after an index came: its edges, and guesses out of files it does not cover."""
    e = table(spark, sf_dir, "edges").select(clean("kind").alias("kind"), clean("src").alias("src"), clean("dst").alias("dst"), "resolution", "confidence")
    e = g.of_kinds(e, g.DEPENDENCY).where("src <> '' and dst <> ''")

    def one(r: str) -> DataFrame:
        return e.where(F.col("resolution") == r).groupBy("kind", "src", "dst").agg(F.coalesce(F.max("confidence"), F.lit(0.5)).alias("conf"))

    return j.merge_precise(one("heuristic"), one("scip"), graph_nodes(spark, sf_dir))


_STEMMED = "regexp_replace(name, '\\d+$', '') || '@' || repository_id"


@query(f"""WITH {E}, {N}, x AS (SELECT {_STEMMED} AS name, id FROM n WHERE kind IN ('class', 'function', 'method') AND name IS NOT NULL AND repository_id IS NOT NULL), m AS (SELECT name, count(*) AS k FROM x GROUP BY 1 HAVING count(*) > 1),
a AS (SELECT m.name, k, h.dst, count(DISTINCT h.src) AS below FROM m JOIN x s ON s.name = m.name JOIN (SELECT DISTINCT src, dst FROM e) h ON h.src = s.id JOIN x t ON t.name = m.name AND t.id = h.dst WHERE h.src <> h.dst GROUP BY 1, 2, 3 HAVING count(DISTINCT h.src) = k - 1)
SELECT name, min(dst) AS pick FROM a GROUP BY name HAVING count(*) = 1""")
def family_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (without their numbers, per repository) of several nodes where one node is what all the others of the name lead to."""
    x = graph_nodes(spark, sf_dir).where(F.col("kind").isin("class", "function", "method") & F.col("name").isNotNull() & F.col("repository_id").isNotNull())
    x = x.select(F.concat(F.regexp_replace("name", r"\d+$", ""), F.lit("@"), "repository_id").alias("name"), "id")
    return j.families(x, graph_edges(spark, sf_dir).select("src", "dst").distinct())


_DIRTY = """ch AS (SELECT repository_id, rel AS file FROM cache_entries WHERE repository_id IS NOT NULL AND rel IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT hash) > 1)"""


@query(f"""WITH {E}, {N}, {_DIRTY}, {F_SQL}, nw AS (SELECT DISTINCT sha256(df.kind || '|' || qname || '|' || df.rel) AS id, df.repo AS repository_id, df.rel AS file FROM df JOIN ch ON ch.repository_id = df.repo AND ch.file = df.rel WHERE df.kind IS NOT NULL AND qname IS NOT NULL),
me AS (SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.repository_id = n.repository_id AND ch.file = n.file) UNION ALL SELECT id FROM nw)
SELECT kind, src, dst FROM e WHERE src IN (SELECT id FROM me) AND dst IN (SELECT id FROM me)""")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges left when files whose content changed are read anew: both ends must be in the merged graph."""
    ch = table(spark, sf_dir, "cache_entries").where("repository_id is not null and rel is not null").groupBy("repository_id", F.col("rel").alias("file")).agg(F.countDistinct("hash").alias("k")).where("k > 1")
    d = defs(spark, sf_dir).where("kind is not null and qname is not null").select(F.sha2(F.concat_ws("|", "kind", "qname", "rel"), 256).alias("id"), F.col("repo").alias("repository_id"), F.col("rel").alias("file")).distinct()
    new = d.join(ch.select("repository_id", "file"), ["repository_id", "file"], "left_semi")
    base = graph_nodes(spark, sf_dir).select("id", "repository_id", "file")
    e = graph_edges(spark, sf_dir).select("kind", "src", "dst")
    return j.overlay(base, e, ch, new.select("id", "repository_id", "file"), e.limit(0), ["repository_id", "file"])[1]


_NOW = "cu AS (SELECT abs, arg_max(content, row(read_at, coalesce(content, ''))) AS content FROM (SELECT abs, read_at, content FROM source_files WHERE abs IS NOT NULL AND content IS NOT NULL AND read_at IS NOT NULL) GROUP BY abs)"


@query(f"""WITH cu AS (SELECT abs, max(row(read_at, sha256(content))) AS x FROM source_files WHERE abs IS NOT NULL AND content IS NOT NULL AND read_at IS NOT NULL GROUP BY abs),
ca AS (SELECT '/srv/checkouts/' || repository_id || '/' || rel AS abs, arg_max(hash, row(cached_at, coalesce(hash, ''))) AS hash FROM cache_entries WHERE cached_at IS NOT NULL AND repository_id IS NOT NULL AND rel IS NOT NULL GROUP BY 1)
SELECT abs, ca.hash AS old, cu.x[2] AS new, CASE WHEN ca.abs IS NULL THEN 'added' WHEN cu.abs IS NULL THEN 'removed' WHEN ca.hash IS NOT DISTINCT FROM cu.x[2] THEN 'same' ELSE 'changed' END AS status FROM ca FULL JOIN cu USING (abs)""")
def freshness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached hash of every file against the hash of its latest readable content; files touched without a change are the same."""
    s = table(spark, sf_dir, "source_files").where("abs is not null and content is not null and read_at is not null")
    now = s.select("abs", "read_at", F.sha2("content", 256).alias("hash")).groupBy("abs").agg(F.max(F.struct("read_at", "hash")).alias("x")).select("abs", "x.hash")
    t = table(spark, sf_dir, "cache_entries").where("cached_at is not null and repository_id is not null and rel is not null")
    t = t.select(F.concat(F.lit("/srv/checkouts/"), "repository_id", F.lit("/"), "rel").alias("abs"), "hash", "cached_at", F.coalesce("hash", F.lit("")).alias("h"))
    return j.snapshot_diff(j.latest(t, ["abs"], ["cached_at", "h"], ["hash"]), now, ["abs"], "hash").select("abs", "old", "new", "status")


_LIB = "lb AS (SELECT repository_id AS repo, lib_name, max(lib_version) AS spec FROM lib_entries WHERE repository_id IS NOT NULL AND lib_name IS NOT NULL GROUP BY 1, 2)"


def _libs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lib_entries").where("repository_id is not null and lib_name is not null")
    return t.groupBy(F.col("repository_id").alias("repo"), "lib_name").agg(F.max("lib_version").alias("spec"))


@query(f"WITH {F_SQL}, {M_SQL}, {_LIB} SELECT DISTINCT mr.repo, mr.spec AS package FROM mr WHERE how = 'external' AND NOT EXISTS (SELECT 1 FROM lb WHERE lb.repo = mr.repo AND lb.lib_name = mr.spec)")
def phantom_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that files import although their repository declares no such library."""
    m = module_resolution(spark, sf_dir).where("how = 'external'").select("repo", F.col("spec").alias("package")).distinct()
    return m.join(_libs(spark, sf_dir).select("repo", F.col("lib_name").alias("package")), ["repo", "package"], "left_anti")


_KIND = "CASE WHEN coalesce(spec, '') IN ('', '*', 'latest', 'x') THEN 'any' WHEN starts_with(spec, '^') THEN 'caret' WHEN starts_with(spec, '~') THEN 'tilde' WHEN regexp_matches(spec, '^=?v?\\d+\\.\\d+\\.\\d+') THEN 'exact' WHEN regexp_matches(spec, '^=?v?\\d') THEN 'partial' ELSE 'other' END"


@query(f"""WITH l AS (SELECT DISTINCT repository_id AS repo, string_split(lib_name, '-')[1] AS stem, lib_version AS spec, source_type FROM lib_entries WHERE repository_id IS NOT NULL AND lib_name IS NOT NULL),
pv AS (SELECT DISTINCT stem, repo AS other FROM l WHERE source_type = 'local'), b AS (SELECT repo, other, stem, max(spec) AS spec FROM l JOIN pv USING (stem) WHERE repo <> other AND source_type <> 'local' GROUP BY 1, 2, 3)
SELECT repo, other, stem, {_KIND} AS kind, CASE {_KIND} WHEN 'exact' THEN 0.95::DOUBLE WHEN 'tilde' THEN 0.9::DOUBLE WHEN 'caret' THEN 0.8::DOUBLE WHEN 'partial' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM b""")
def bridge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries of a repository that another one keeps itself: edges between repositories, sure by how tightly the version binds."""
    t = table(spark, sf_dir, "lib_entries").where("repository_id is not null and lib_name is not null")
    t = t.select(F.col("repository_id").alias("repo"), F.substring_index("lib_name", "-", 1).alias("stem"), F.col("lib_version").alias("spec"), "source_type")
    pv = t.where("source_type = 'local'").select("stem", F.col("repo").alias("other")).distinct()
    b = t.where("source_type <> 'local'").join(pv, "stem").where("repo <> other").groupBy("repo", "other", "stem").agg(F.max("spec").alias("spec"))
    k = range_kind(F.col("spec"))
    conf = F.when(k == "exact", 0.95).when(k == "tilde", 0.9).when(k == "caret", 0.8).when(k == "partial", 0.7).otherwise(0.5)
    return b.select("repo", "other", "stem", k.alias("kind"), conf.alias("confidence"))


@query(f"""WITH {E}, {N}, l AS (SELECT DISTINCT repository_id AS repo, regexp_replace(lib_name, '\\d+$', '') AS stem FROM lib_entries WHERE repository_id IS NOT NULL AND lib_name IS NOT NULL),
h AS (SELECT repo, stem, 'library' AS via, 0.9::DOUBLE AS conf FROM l UNION ALL SELECT a.repository_id, b.repository_id, 'edge', max(e.conf) FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.repository_id <> b.repository_id AND e.conf >= 0.8 GROUP BY 1, 2)
SELECT repo, stem AS other, arg_min(via, row(-conf, via)) AS via, max(conf) AS conf FROM h GROUP BY 1, 2""")
def federation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each repository leans on, from two lists (its libraries, its sure edges into others), one row per pair, the surer list's."""
    l = table(spark, sf_dir, "lib_entries").where("repository_id is not null and lib_name is not null").select(F.col("repository_id").alias("repo"), F.regexp_replace("lib_name", r"\d+$", "").alias("other")).distinct()
    l = l.select("repo", "other", F.lit("library").alias("via"), F.lit(0.9).alias("conf"))
    n = graph_nodes(spark, sf_dir).select("id", "repository_id")
    e = graph_edges(spark, sf_dir).where("conf >= 0.8").join(n.select(F.col("id").alias("src"), F.col("repository_id").alias("repo")), "src").join(n.select(F.col("id").alias("dst"), F.col("repository_id").alias("other")), "dst")
    e = e.where("repo <> other").groupBy("repo", "other").agg(F.max("conf").alias("conf")).select("repo", "other", F.lit("edge").alias("via"), "conf")
    return l.union(e).groupBy("repo", "other").agg(F.min_by("via", F.struct(-F.col("conf"), F.col("via"))).alias("via"), F.max("conf").alias("conf"))


@query(f"""WITH {F_SQL}, {M_SQL}, {_LIB}, us AS (SELECT mr.repo, spec AS lib_name, count(DISTINCT mr.rel) AS n_files FROM mr WHERE how = 'external' GROUP BY 1, 2),
qc AS (SELECT mr.repo, mr.spec AS lib_name, count(*) AS n_calls FROM mr JOIN cl ON cl.repo = mr.repo AND cl.rel = mr.rel WHERE how = 'external' AND cl.qualified GROUP BY 1, 2),
al AS (SELECT repo, lib_name FROM lb UNION SELECT repo, lib_name FROM us)
SELECT al.repo, al.lib_name, lb.lib_name IS NOT NULL AS declared, coalesce(n_files, 0) AS n_files, coalesce(n_calls, 0) AS n_calls,
CASE WHEN n_calls > 0 THEN 'called' WHEN n_files > 0 THEN 'imported' ELSE 'declared' END AS tier, least(CASE WHEN n_calls > 0 THEN 0.6 + 0.05 * n_calls WHEN n_files > 0 THEN 0.4 + 0.05 * n_files ELSE 0.2 END, 0.95)::DOUBLE AS confidence
FROM al LEFT JOIN lb USING (repo, lib_name) LEFT JOIN us USING (repo, lib_name) LEFT JOIN qc USING (repo, lib_name)""")
def reachability_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each library of each repository: called, imported or only declared, with a capped confidence."""
    m = module_resolution(spark, sf_dir).where("how = 'external'")
    us = m.groupBy("repo", F.col("spec").alias("lib_name")).agg(F.countDistinct("rel").alias("n_files"))
    qc = m.join(calls(spark, sf_dir).where("qualified").groupBy("repo", "rel").agg(F.count(F.lit(1)).alias("k")), ["repo", "rel"]).groupBy("repo", F.col("spec").alias("lib_name")).agg(F.sum("k").alias("n_calls"))
    lb = _libs(spark, sf_dir).select("repo", "lib_name", F.lit(True).alias("declared"))
    x = lb.join(us, ["repo", "lib_name"], "full_outer").join(qc, ["repo", "lib_name"], "left").fillna(0, ["n_files", "n_calls"]).fillna(False, ["declared"])
    tier = F.when(F.col("n_calls") > 0, "called").when(F.col("n_files") > 0, "imported").otherwise("declared")
    conf = F.when(F.col("n_calls") > 0, 0.6 + 0.05 * F.col("n_calls")).when(F.col("n_files") > 0, 0.4 + 0.05 * F.col("n_files")).otherwise(0.2)
    return x.select("repo", "lib_name", "declared", "n_files", "n_calls", tier.alias("tier"), F.least(conf, F.lit(0.95)).alias("confidence"))


def _v(x: str) -> str:
    m = "'(\\d{1,9})(?:\\.(\\d{1,9}))?(?:\\.(\\d{1,9}))?'"
    return "[" + ", ".join(f"coalesce(try_cast(regexp_extract({x}, {m}, {i}) AS INT), 0)" for i in (1, 2, 3)) + "]"


_DEPS = f"""dp AS (SELECT DISTINCT l_partkey AS package, l_suppkey % 50 || '.' || l_linenumber || '.' || CAST(l_quantity AS INT) AS v FROM lineitem),
av AS (SELECT p_partkey AS package, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size || '.0' END AS introduced, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size + 9) || '.3.1' END AS fixed FROM part)"""


def _package_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(".", (F.col("l_suppkey") % 50).cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("package"), text.alias("text")).distinct().withColumn("v", version(F.col("text")))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    low = F.when(size % 7 == 0, None).otherwise(F.concat(size.cast("string"), F.lit(".0")))
    high = F.when(size % 5 == 0, None).otherwise(F.concat((size + 9).cast("string"), F.lit(".3.1")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("package"), version(low).alias("introduced"), version(high).alias("fixed"))


@query(f"""WITH {_DEPS} SELECT dp.package, v AS version FROM dp JOIN av USING (package) WHERE (introduced IS NULL OR {_v('v')} >= {_v('introduced')}) AND (fixed IS NULL OR {_v('v')} < {_v('fixed')})""")
def vuln_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in use that an advisory's window holds; open where a bound is missing."""
    return j.affected(_package_versions(spark, sf_dir), _windows(spark, sf_dir), "package", "v").select("package", F.col("text").alias("version"))


@query(f"""WITH {_DEPS} SELECT package, count(*) AS n_versions FROM (SELECT dp.package, v FROM dp JOIN av USING (package) WHERE (introduced IS NOT NULL OR fixed IS NOT NULL) AND (introduced IS NULL OR {_v('v')} >= {_v('introduced')}) AND (fixed IS NULL OR {_v('v')} < {_v('fixed')})) GROUP BY 1""")
def vuln_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the range join in the evidence reading, where a window without bounds holds nothing; versions per package."""
    x = j.affected(_package_versions(spark, sf_dir), _windows(spark, sf_dir), "package", "v", empty_matches=False)
    return x.groupBy("package").agg(F.count(F.lit(1)).alias("n_versions"))


@query(f"""WITH {_DEPS} SELECT dp.package, v AS version, CASE WHEN fixed IS NULL THEN true ELSE {_v('v')} < {_v('fixed')} END AS affected FROM dp JOIN av USING (package) WHERE introduced IS NULL""")
def advisory_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories without a lower bound: affected below the fix, or always where there is none."""
    x = _package_versions(spark, sf_dir).join(_windows(spark, sf_dir).where("introduced is null"), "package")
    return x.select("package", F.col("text").alias("version"), F.coalesce(F.col("v") < F.col("fixed"), F.lit(True)).alias("affected"))


@query(f"""WITH {_DEPS}, m AS (SELECT package, min({_v('v')}) AS a, max({_v('v')}) AS b FROM dp GROUP BY 1)
SELECT package, a[1] AS from_major, b[1] AS to_major, CASE WHEN b[1] > a[1] THEN 'major' WHEN b[2] > a[2] THEN 'minor' WHEN b > a THEN 'patch' ELSE 'none' END AS jump, greatest(b[1] - a[1] - 1, 0) AS n_between FROM m""")
def version_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per package, the step from the lowest to the highest version and how many majors lie between."""
    m = _package_versions(spark, sf_dir).groupBy("package").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return m.select("package", F.col("a.major").alias("from_major"), F.col("b.major").alias("to_major"), jump(F.col("a"), F.col("b")).alias("jump"), F.size(majors_between(F.col("a.major"), F.col("b.major"))).alias("n_between"))


@query("""WITH r AS (SELECT lib_name, lib_version, added_at, """ + _v("lib_version") + """ AS v FROM lib_entries WHERE regexp_matches(lib_version, '\\d') AND lib_name IS NOT NULL)
SELECT regexp_replace(lib_name, '\\d+$', '') AS family, arg_max(lib_version, row(v, lib_version)) AS newest, max(added_at) FILTER (added_at <= TIMESTAMPTZ '2026-06-01 00:00:00+00') IS NOT NULL AS known FROM r WHERE added_at <= TIMESTAMPTZ '2026-06-01 00:00:00+00' GROUP BY 1""")
def newest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family of libraries the highest version that was there on a stated day."""
    r = table(spark, sf_dir, "lib_entries").where(F.col("lib_version").rlike(r"\d") & F.col("lib_name").isNotNull() & (F.col("added_at") <= F.lit("2026-06-01 00:00:00").cast("timestamp")))
    r = r.select(F.regexp_replace("lib_name", r"\d+$", "").alias("family"), "lib_version", version(F.col("lib_version")).alias("v"))
    return j.latest(r, ["family"], ["v", "lib_version"], ["lib_version"]).select("family", F.col("lib_version").alias("newest"), F.lit(True).alias("known"))


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderdate AS t FROM orders), x AS (SELECT o_custkey AS k, o_orderdate AS t, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT q.id, max(x.t) AS at_prev, arg_max(x.price, x.t) AS price FROM q LEFT JOIN x ON x.k = q.k AND x.t <= q.t GROUP BY q.id""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the customer's latest finished one up to then, merged in one pass."""
    o = table(spark, sf_dir, "orders")
    q = o.select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"))
    x = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at_prev")).agg(F.max("o_totalprice").alias("price")).withColumn("u", F.col("at_prev"))
    got = j.nearest(q, x, ["k"], "t", "u", ["at_prev", "price"])
    return got.select(F.col("point_id").alias("id"), "at_prev", "price")


@query("""WITH t AS (SELECT task_id, min(abs) AS abs FROM parse_tasks WHERE task_id IS NOT NULL AND abs IS NOT NULL GROUP BY 1), d AS (SELECT regexp_replace(abs, '/[^/]*$', '') AS dir FROM t), lab AS (SELECT dir, count(*) AS n_files FROM d GROUP BY 1 HAVING count(*) >= 2),
up AS (SELECT task_id, array_to_string(p[1:k], '/') AS dir, k FROM (SELECT task_id, string_split(regexp_replace(abs, '/[^/]*$', ''), '/') AS p, unnest(generate_series(1, len(string_split(regexp_replace(abs, '/[^/]*$', ''), '/')))) AS k FROM t))
SELECT t.task_id, arg_max(lab.dir, k) AS folder, arg_max(lab.n_files, k) AS n_files FROM t LEFT JOIN (up JOIN lab ON lab.dir = up.dir) ON up.task_id = t.task_id GROUP BY 1""")
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the closest directory above it that holds two files or more."""
    from graphloom.functions.paths import directory

    t = table(spark, sf_dir, "parse_tasks").where("task_id is not null and abs is not null").groupBy(F.col("task_id").alias("item_id")).agg(F.min("abs").alias("abs"))
    lab = t.groupBy(directory(F.col("abs")).alias("folder")).agg(F.count(F.lit(1)).alias("n_files")).where("n_files >= 2").withColumn("dir", F.col("folder"))
    return j.owners(t, "abs", lab, "dir", ["folder", "n_files"]).select(F.col("item_id").alias("task_id"), "folder", "n_files")


@query("""WITH t AS (SELECT DISTINCT abs FROM parse_tasks WHERE abs IS NOT NULL) SELECT t.abs, arg_max(r.repository_id, length(r.root_path)) AS repository_id FROM t LEFT JOIN repositories r ON starts_with(t.abs, r.root_path || '/') GROUP BY 1""")
def project_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the repository whose root is the longest above it."""
    t = table(spark, sf_dir, "parse_tasks").where("abs is not null").select("abs", F.col("abs").alias("item_id")).distinct()
    return j.owners(t, "abs", table(spark, sf_dir, "repositories"), "root_path", ["repository_id"]).select("abs", "repository_id")


@query(f"WITH {N}, x AS (SELECT DISTINCT name, repository_id FROM n WHERE name IS NOT NULL AND repository_id IS NOT NULL), m AS (SELECT name, count(*) AS n_sites FROM x GROUP BY 1 HAVING count(*) >= 2) SELECT name, repository_id, n_sites FROM x JOIN m USING (name)")
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that nodes of two repositories or more bear, with their places."""
    return j.shared_keys(graph_nodes(spark, sf_dir), "name", "repository_id").select("name", "repository_id", "n_sites")


@query(f"""WITH {F_SQL}, ln AS (SELECT repo, rel, line, bool_or(qualified) AS hit FROM cl WHERE line IS NOT NULL GROUP BY 1, 2, 3), x AS (SELECT df.repo, df.rel, df.ord, count(*) AS n_lines, count(*) FILTER (hit) AS n_hit FROM df JOIN ln ON ln.repo = df.repo AND ln.rel = df.rel AND ln.line BETWEEN df.start_line AND df.end_line GROUP BY 1, 2, 3)
SELECT repo, rel, ord, n_lines, n_hit, {r6('n_hit / n_lines', 4)} AS fraction FROM x""")
def coverage_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per definition, the share of its measured lines that were hit (a line with a qualified call counts as hit)."""
    ln = calls(spark, sf_dir).where("line is not null").groupBy("repo", "rel", "line").agg(F.bool_or("qualified").alias("hit"))
    d = defs(spark, sf_dir).select("repo", "rel", "ord", "start_line", "end_line")
    x = d.join(ln, ["repo", "rel"]).where("line between start_line and end_line").groupBy("repo", "rel", "ord").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("hit").alias("n_hit"))
    return x.withColumn("fraction", half_up(F.col("n_hit") / F.col("n_lines"), 4))


@query(f"""WITH {N}, {_LIB}, w AS (SELECT DISTINCT id, repository_id AS repo, lower(unnest(regexp_extract_all(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'))) AS t FROM n WHERE kind NOT IN ('file', 'external')),
k AS (SELECT DISTINCT repo, lib_name, regexp_replace(unnest(string_split(lower(lib_name), '-')), '\\d+$', '') AS t FROM lb)
SELECT w.id, k.lib_name, count(*) AS score FROM w JOIN k ON k.repo = w.repo AND k.t = regexp_replace(w.t, '\\d+$', '') AND k.t <> '' GROUP BY 1, 2 HAVING count(*) >= 2""")
def grounding_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the libraries of their repository that share two parts of their name or more."""
    words = F.regexp_extract_all(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), F.lit("[A-Za-z0-9]+"), F.lit(0))
    w = graph_nodes(spark, sf_dir).where(~F.col("kind").isin("file", "external")).select("id", F.col("repository_id").alias("repo"), F.explode(words).alias("t")).select("id", "repo", F.lower("t").alias("t")).distinct().withColumn("t", F.regexp_replace("t", r"\d+$", ""))
    k = _libs(spark, sf_dir).select("repo", "lib_name", F.explode(F.split(F.lower("lib_name"), "-")).alias("t")).withColumn("t", F.regexp_replace("t", r"\d+$", "")).distinct().where("t <> ''")
    return w.join(k, ["repo", "t"]).groupBy("id", "lib_name").agg(F.count(F.lit(1)).alias("score")).where("score >= 2")
