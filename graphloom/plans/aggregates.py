"""Queries of the aggregate family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.numbers import clamp, half_up
from graphloom.functions.paths import directory, extension
from graphloom.operators import aggregates as ag
from graphloom.operators import graph as g
from graphloom.plans.resolve import F_SQL, M_SQL, defs, module_resolution
from graphloom.plans.timeline import V_SQL, events
from graphloom.plans.views import DEP_SQL, E, N, graph_edges, graph_nodes, r6
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


@query(f"""WITH {V_SQL} SELECT tool, client, outcome, count(*) AS calls, count(*) FILTER (outcome = 'complete') AS complete, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'miss') AS miss,
{r6("100.0 * count(*) FILTER (outcome <> 'miss') / count(*)", 2)} AS success, {r6('avg(ms)', 3)} AS avg_ms FROM v GROUP BY GROUPING SETS ((tool), (client), (outcome), ())""")
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, outcomes, success and mean time by tool, by client, by outcome and over all, in one pass; unmeasured times don't count."""
    v = events(spark, sf_dir)
    # inside grouping sets the grouped outcome is null where it is rolled up: count on a copy
    v = v.withColumn("oc", F.col("outcome"))
    sets = v.groupingSets([[F.col("tool")], [F.col("client")], [F.col("outcome")], []], F.col("tool"), F.col("client"), F.col("outcome"))
    oc = F.col("oc")
    return sets.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(oc == "complete").alias("complete"), F.count_if(oc == "partial").alias("partial"), F.count_if(oc == "miss").alias("miss"),
        ag.success_rate(oc != "miss").alias("success"), half_up(F.avg("ms"), 3).alias("avg_ms"),
    )


@query(f"""WITH {V_SQL}, t AS (SELECT tool, {r6("100.0 * count(*) FILTER (outcome <> 'miss') / count(*)", 2)} AS s FROM v GROUP BY 1) SELECT {r6('avg(s)', 2)} AS mean_success, min(s) AS least, max(s) AS most FROM t""")
def usage_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unweighted mean of the tools' success."""
    t = events(spark, sf_dir).groupBy("tool").agg(ag.success_rate(F.col("outcome") != "miss").alias("s"))
    return t.agg(half_up(F.avg("s"), 2).alias("mean_success"), F.min("s").alias("least"), F.max("s").alias("most"))


@query(f"""WITH {V_SQL} SELECT count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(baseline) AS BIGINT) AS baseline, {r6('sum(baseline) / sum(tokens)', 2)} AS ratio FROM v WHERE ts >= TIMESTAMP '2024-01-02 00:00:00'""")
def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens against the baseline over the 29 days before a stated day."""
    v = events(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-31 00:00:00").cast("timestamp") - F.expr("interval 29 days"))
    return v.agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("baseline").alias("baseline"), half_up(F.sum("baseline") / F.sum("tokens"), 2).alias("ratio"))


@query(f"WITH {V_SQL} SELECT model, client, CAST(sum(baseline - tokens) AS BIGINT) AS saved, count(*) AS calls FROM v GROUP BY 1, 2")
def model_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved tokens by model and client, greatest first."""
    m = events(spark, sf_dir).groupBy("model", "client").agg(F.sum(F.col("baseline") - F.col("tokens")).alias("saved"), F.count(F.lit(1)).alias("calls"))
    return m.orderBy(F.desc("saved"), "model", "client")


@query(f"WITH {V_SQL} SELECT tool, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, epoch_us(max(ts)) AS last_us FROM v GROUP BY 1")
def live_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of several processes added up by tool; the last call is the latest of theirs."""
    part = events(spark, sf_dir).groupBy("tool", "client").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last"))
    return part.groupBy("tool").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.unix_micros(F.max("last")).alias("last_us"))


@query(f"WITH {V_SQL} SELECT model, client, tool, outcome, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM v WHERE event_id >= 1000 GROUP BY 1, 2, 3, 4")
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came since an offset, by model, client, tool and outcome."""
    return events(spark, sf_dir).where("event_id >= 1000").groupBy("model", "client", "tool", "outcome").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us")
    )


# dependencies: the customer is the project, the part the package; a tenth of the ages is unknown
D_SQL = """m AS (SELECT l_partkey, max(l_shipdate) AS newest FROM lineitem GROUP BY 1), dp AS (SELECT o_custkey AS project, l.l_partkey AS package, l_linenumber - 1 AS behind,
CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.4 END::DOUBLE AS weight, l_suppkey % 20 = 0 AS unsupported,
CASE WHEN l.l_partkey % 10 <> 0 THEN (epoch_us(newest) - epoch_us(l_shipdate)) / 864e8 / 365.25 END AS libyears FROM lineitem l JOIN (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY 1) ON o_orderkey = l_orderkey JOIN m ON m.l_partkey = l.l_partkey)"""


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as dependencies: project, package, majors behind, weight of the section, whether unsupported, and libyears behind the newest."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("project"))
    m = l.groupBy("l_partkey").agg(F.max("l_shipdate").alias("newest"))
    us = F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    w = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.4)
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(m, "l_partkey").select(
        "project", F.col("l_partkey").alias("package"), (F.col("l_linenumber") - 1).alias("behind"), w.alias("weight"), (F.col("l_suppkey") % 20 == 0).alias("unsupported"),
        F.when(F.col("l_partkey") % 10 != 0, us / F.lit(864e8) / F.lit(365.25)).alias("libyears"),
    )


@query(f"""WITH {D_SQL}, a AS (SELECT project, {r6('sum(libyears)', 4)} AS total, {r6('max(libyears)', 4)} AS most, count(libyears) AS measured, avg(libyears) AS mean, max(libyears) AS mx FROM dp GROUP BY 1)
SELECT project, total, most, measured, CASE WHEN measured > 0 THEN greatest(0, least(100, {r6('100 - (0.7 * least(20 * mean, 100) + 0.3 * least(10 * mx, 100))', 0)})) END AS freshness FROM a""")
def libyear_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project: libyears in all, the most, how many were measured, and a freshness of 0 to 100 from their mean and most; null where none was."""
    y = F.col("libyears")
    a = dependencies(spark, sf_dir).groupBy("project").agg(half_up(F.sum(y), 4).alias("total"), half_up(F.max(y), 4).alias("most"), F.count(y).alias("measured"), F.avg(y).alias("mean"), F.max(y).alias("mx"))
    f = 100 - (0.7 * F.least(20 * F.col("mean"), F.lit(100.0)) + 0.3 * F.least(10 * F.col("mx"), F.lit(100.0)))
    return a.select("project", "total", "most", "measured", clamp(half_up(F.when(F.col("measured") > 0, f), 0), 0.0, 100.0).alias("freshness"))


_POINTS = "CASE WHEN behind <= 0 THEN 0 WHEN behind = 1 THEN 15 WHEN behind = 2 THEN 45 WHEN behind = 3 THEN 70 WHEN behind = 4 THEN 85 ELSE 100 END::DOUBLE"
_DRIFT = f"CASE WHEN libyears IS NULL THEN {_POINTS} ELSE 0.55 * {_POINTS} + 0.45 * least(25 * libyears, 100) END"


def drift_points() -> F.Column:
    """Points of 0 to 100 by majors behind, blended with 25 points a libyear where the age is known."""
    b = F.col("behind")
    p = F.when(b <= 0, 0.0).when(b == 1, 15.0).when(b == 2, 45.0).when(b == 3, 70.0).when(b == 4, 85.0).otherwise(100.0)
    return F.when(F.col("libyears").isNull(), p).otherwise(0.55 * p + 0.45 * F.least(25 * F.col("libyears"), F.lit(100.0)))


@query(f"WITH {D_SQL} SELECT package, count(*) AS n, {r6(f'avg({_DRIFT})', 3)} AS mean, {r6(f'max({_DRIFT})', 3)} AS most FROM dp GROUP BY 1")
def per_dependency_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and greatest drift of every package."""
    d = dependencies(spark, sf_dir).withColumn("drift", drift_points())
    return d.groupBy("package").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("drift"), 3).alias("mean"), half_up(F.max("drift"), 3).alias("most"))


_AGG = f"""{D_SQL}, x AS (SELECT *, {r6(_DRIFT, 4)} AS drift FROM dp), a AS (SELECT project, sum(drift * weight) / sum(weight) AS wmean, quantile_disc(drift, 0.95) AS p95, avg(unsupported::INT) AS share, count(*) AS n, count(libyears) AS known, max(behind) AS lag FROM x GROUP BY 1)"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dependencies(spark, sf_dir).withColumn("drift", half_up(drift_points(), 4))
    a = d.groupBy("project").agg(
        ag.weighted_mean(F.col("drift"), F.col("weight")).alias("wmean"), F.avg(F.col("unsupported").cast("int")).alias("share"), F.count(F.lit(1)).alias("n"),
        F.count("libyears").alias("known"), F.max("behind").alias("lag"),
    )
    return a.join(ag.nearest_rank_by_count(d, ["project"], "drift", 0.95, "p95"), "project")


@query(f"WITH {_AGG} SELECT project, n, {r6('wmean', 3)} AS wmean, p95, {r6('share', 4)} AS unsupported, {r6('known / n', 4)} AS coverage, greatest(0, least(100, {r6('0.5 * wmean + 0.3 * p95 + 20 * share', 0)})) AS score FROM a")
def drift_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project: weighted mean, 95th nearest-rank percentile and unsupported share of the drift, joined into one score."""
    s = 0.5 * F.col("wmean") + 0.3 * F.col("p95") + 20 * F.col("share")
    return _drift(spark, sf_dir).select(
        "project", "n", half_up(F.col("wmean"), 3).alias("wmean"), "p95", half_up(F.col("share"), 4).alias("unsupported"), half_up(F.col("known") / F.col("n"), 4).alias("coverage"),
        clamp(half_up(s, 0), 0.0, 100.0).alias("score"),
    )


_RUN = "CASE WHEN lag IS NULL OR project % 9 = 0 THEN NULL WHEN lag <= 0 THEN 100 WHEN lag = 1 THEN 80 WHEN lag = 2 THEN 50 WHEN lag = 3 THEN 20 ELSE 0 END::DOUBLE"
_EOL = "CASE WHEN project % 4 = 0 THEN NULL ELSE 100 * (1 - share) END"


@query(f"""WITH {_AGG}, q AS (SELECT project, {_RUN} AS a, 100 - wmean AS b, 100 - p95 AS c, {_EOL} AS d FROM a),
s AS (SELECT project, (coalesce(a * 0.25, 0) + coalesce(b * 0.25, 0) + coalesce(c * 0.30, 0) + coalesce(d * 0.20, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + 0.25 + 0.30 + CASE WHEN d IS NULL THEN 0 ELSE 0.20 END) AS health FROM q)
SELECT project, {r6('100 - health', 2)} AS score, CASE WHEN {r6('100 - health', 2)} >= 60 THEN 'high' WHEN {r6('100 - health', 2)} >= 30 THEN 'moderate' ELSE 'low' END AS band FROM s""")
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts of health, weights renormalised over the known ones, turned into a score and a band."""
    lag, p = F.col("lag"), F.col("project")
    run = F.when(lag.isNull() | (p % 9 == 0), None).when(lag <= 0, 100.0).when(lag == 1, 80.0).when(lag == 2, 50.0).when(lag == 3, 20.0).otherwise(0.0)
    eol = F.when(p % 4 != 0, 100 * (1 - F.col("share")))
    h = ag.renormalised([(run, 0.25), (100 - F.col("wmean"), 0.25), (100 - F.col("p95"), 0.30), (eol, 0.20)])
    s = _drift(spark, sf_dir).select("project", half_up(100 - h, 2).alias("score"))
    return s.withColumn("band", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "moderate").otherwise("low"))


@query(f"""WITH {D_SQL}, x AS (SELECT project, {_DRIFT} AS drift, CASE WHEN package % 3 = 0 THEN 0 ELSE {_DRIFT} END AS then_drift FROM dp) SELECT project, {r6('avg(drift)', 3)} AS now, {r6('avg(then_drift)', 3)} AS upgraded FROM x GROUP BY 1""")
def what_if_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean drift of every project now and with a set of packages upgraded."""
    d = dependencies(spark, sf_dir).withColumn("drift", drift_points())
    return d.groupBy("project").agg(half_up(F.avg("drift"), 3).alias("now"), half_up(F.avg(F.when(F.col("package") % 3 == 0, 0.0).otherwise(F.col("drift"))), 3).alias("upgraded"))


@query(f"WITH {D_SQL} SELECT package, count(DISTINCT project) AS n_projects FROM dp GROUP BY 1 HAVING count(DISTINCT project) >= 2 ORDER BY 2 DESC, 1 LIMIT 30")
def package_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 packages that most projects share."""
    d = dependencies(spark, sf_dir).select("project", "package").distinct()
    return d.groupBy("package").agg(F.count(F.lit(1)).alias("n_projects")).where("n_projects >= 2").orderBy(F.desc("n_projects"), "package").limit(30)


@query("SELECT l_partkey AS package, count(DISTINCT l_suppkey % 50) AS n, array_to_string(list_sort(list(DISTINCT l_suppkey % 50)), ',') AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 50) > 1")
def duplicate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages in use in more than one version, with the versions in order."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("package"), (F.col("l_suppkey") % 50).alias("v")).distinct()
    d = v.groupBy("package").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("v")).alias("versions")).where("n > 1")
    return d.withColumn("versions", F.array_join(F.transform("versions", lambda x: x.cast("string")), ","))


_EXT = "lower(regexp_extract(regexp_replace(abs, '^.*/', ''), '^.+\\.([A-Za-z0-9]+)$', 1))"


@query(f"""WITH t AS (SELECT abs, max(octet_length(encode(content))) AS size FROM source_files WHERE abs IS NOT NULL AND content IS NOT NULL GROUP BY 1)
SELECT {_EXT} AS ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest, max(len(string_split(abs, '/'))) AS depth FROM t GROUP BY 1""")
def extension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes, largest file and greatest depth by extension."""
    t = table(spark, sf_dir, "source_files").where("abs is not null and content is not null").groupBy("abs").agg(F.max(F.octet_length("content")).alias("size"))
    return t.groupBy(extension(F.col("abs")).alias("ext")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"), F.max("size").cast("long").alias("largest"), F.max(F.size(F.split("abs", "/"))).cast("long").alias("depth")
    )


@query("WITH t AS (SELECT abs, max(octet_length(encode(content))) AS size FROM source_files WHERE abs IS NOT NULL AND content IS NOT NULL GROUP BY 1) SELECT abs, size FROM t ORDER BY size DESC, abs LIMIT 20")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest files."""
    t = table(spark, sf_dir, "source_files").where("abs is not null and content is not null").groupBy("abs").agg(F.max(F.octet_length("content")).cast("long").alias("size"))
    return t.orderBy(F.desc("size"), "abs").limit(20)


@query(f"WITH {N} SELECT repository_id, kind, arg_min(lang, row(-importance, lang)) AS lang, max(importance) AS importance FROM n WHERE importance >= 0.3 AND lang IS NOT NULL GROUP BY 1, 2")
def evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and kind, the language that the surest node stands for; evidence below 0.3 doesn't count."""
    n = graph_nodes(spark, sf_dir).where("lang is not null")
    return ag.argmax(n, ["repository_id", "kind"], "lang", "importance", 0.3)


@query("""WITH t AS (SELECT task_id, min(abs) AS abs FROM parse_tasks WHERE task_id IS NOT NULL AND abs IS NOT NULL GROUP BY 1), x AS (SELECT regexp_replace(abs, '/[^/]*$', '') AS dir, """ + _EXT + """ AS ext FROM t),
c AS (SELECT dir, ext, count(*) AS n, sum(count(*)) OVER (PARTITION BY dir) AS total, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, ext) AS k FROM x GROUP BY 1, 2)
SELECT dir, ext, n, CAST(total AS BIGINT) AS total FROM c WHERE k = 1 AND n >= 2 AND n >= total * 0.6""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extension most files directly in a directory have, where it is two files and 60 % or more."""
    t = table(spark, sf_dir, "parse_tasks").where("task_id is not null and abs is not null").groupBy("task_id").agg(F.min("abs").alias("abs"))
    return ag.majority(t.select(directory(F.col("abs")).alias("dir"), extension(F.col("abs")).alias("ext")), ["dir"], "ext", 0.6, 2)


@query(f"""WITH {E}, {N}, x AS (SELECT e.src AS id, b.area FROM e JOIN n b ON b.id = e.dst WHERE b.area IS NOT NULL UNION ALL SELECT e.dst, a.area FROM e JOIN n a ON a.id = e.src WHERE a.area IS NOT NULL),
c AS (SELECT id, area, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, area) AS k FROM x GROUP BY 1, 2)
SELECT c.id, c.area, c.n, CAST(total AS BIGINT) AS total, CASE WHEN n.area = c.area THEN 'confirm' WHEN n.area IS NULL THEN 'adopt' ELSE 'conflict' END AS verdict FROM c JOIN n USING (id) WHERE k = 1 AND c.n >= 3 AND c.n >= total * 0.5""")
def neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area half or more of a node's neighbours are in, against its own."""
    n, e = graph_nodes(spark, sf_dir).select("id", "area"), graph_edges(spark, sf_dir).select("src", "dst")
    out = e.join(n.select(F.col("id").alias("dst"), "area"), "dst").select(F.col("src").alias("id"), "area")
    back = e.join(n.select(F.col("id").alias("src"), "area"), "src").select(F.col("dst").alias("id"), "area")
    m = ag.majority(out.union(back), ["id"], "area", 0.5, 3)
    own = n.select("id", F.col("area").alias("own"))
    v = F.when(F.col("own") == F.col("area"), "confirm").when(F.col("own").isNull(), "adopt").otherwise("conflict")
    return m.join(own, "id").select("id", "area", "n", "total", v.alias("verdict"))


@query("""WITH b AS (SELECT p_brand AS slug, p_type AS category, max(p_retailprice) AS score FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, slug) AS r FROM b)
SELECT slug, max(score) AS score, count(DISTINCT category) AS n_categories FROM k WHERE r <= 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def recommendation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each category, merged by name with their best score, the first 20 over all."""
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("slug"), F.col("p_type").alias("category")).agg(F.max("p_retailprice").alias("score"))
    top = g.top_per_key(b, ["category"], [F.desc("score"), "slug"], 3)
    return top.groupBy("slug").agg(F.max("score").alias("score"), F.countDistinct("category").alias("n_categories")).orderBy(F.desc("score"), "slug").limit(20)


@query(f"""WITH {F_SQL}, {M_SQL}, u AS (SELECT DISTINCT repo, spec FROM mr WHERE how = 'external'), s AS (SELECT spec FROM u GROUP BY 1 HAVING count(*) >= 5)
SELECT repo, count(*) AS n, count(*) FILTER (spec IN (SELECT spec FROM s)) AS n_common, {r6('count(*) FILTER (spec IN (SELECT spec FROM s)) / count(*)', 4)} AS share FROM u GROUP BY 1""")
def framework_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository, the share of its packages that five repositories or more use."""
    u = module_resolution(spark, sf_dir).where("how = 'external'").select("repo", "spec").distinct()
    s = u.groupBy("spec").agg((F.count(F.lit(1)) >= 5).alias("common"))
    x = u.join(s, "spec").groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if("common").alias("n_common"))
    return x.withColumn("share", half_up(F.col("n_common") / F.col("n"), 4))


_CATEGORIES = (("log", "logging"), ("fmt", "text"), ("java.util", "collections"), ("std", "runtime"), ("set", "collections"), ("re", "text"), ("json", "text"), ("os", "runtime"))


@query(f"""WITH {F_SQL}, {M_SQL}, c AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _CATEGORIES)}) c(spec, category))
SELECT coalesce(category, 'other') AS category, count(DISTINCT mr.spec) AS n_packages, count(DISTINCT repo) AS n_repositories, count(*) AS n_sites FROM mr LEFT JOIN c USING (spec) WHERE how = 'external' GROUP BY 1""")
def service_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External packages by category, from a small fixed table."""
    c = spark.createDataFrame(list(_CATEGORIES), "spec string, category string")
    m = module_resolution(spark, sf_dir).where("how = 'external'").join(F.broadcast(c), "spec", "left").withColumn("category", F.coalesce("category", F.lit("other")))
    return m.groupBy("category").agg(F.countDistinct("spec").alias("n_packages"), F.countDistinct("repo").alias("n_repositories"), F.count(F.lit(1)).alias("n_sites"))


@query(f"""WITH {F_SQL}, {M_SQL}, k AS (SELECT spec, repo || ':' || rel AS file, row_number() OVER (PARTITION BY spec ORDER BY repo || ':' || rel) AS r FROM mr WHERE how = 'external')
SELECT spec AS package, count(*) AS n_sites, count(DISTINCT file) AS n_files, string_agg(file, ',' ORDER BY file) FILTER (r <= 3) AS samples FROM k GROUP BY 1""")
def usage_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per external package: import sites, files, and the first three files."""
    m = module_resolution(spark, sf_dir).where("how = 'external'").select(F.col("spec").alias("package"), F.concat_ws(":", "repo", "rel").alias("file"))
    per = m.groupBy("package").agg(F.count(F.lit(1)).alias("n_sites"), F.countDistinct("file").alias("n_files"))
    s = g.top_per_key(m.distinct(), ["package"], ["file"], 3).groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("samples"))
    return per.join(s, "package")


@query(f"""WITH {F_SQL}, {E}, {N}, ln AS (SELECT repo, rel, count(*) AS n_defs, max(end_line - start_line + 1) AS longest, avg(end_line - start_line + 1) AS mean FROM df GROUP BY 1, 2),
q AS (SELECT repo, count(*) AS n_files, CAST(sum(n_defs) AS BIGINT) AS n_defs, max(longest) AS longest, {r6('avg(mean)', 3)} AS mean_length, count(*) FILTER (n_defs >= 10 OR longest >= 60) AS n_god_files FROM ln GROUP BY 1),
dd AS (SELECT repository_id AS repo, count(*) FILTER (id NOT IN (SELECT dst FROM e WHERE kind IN {DEP_SQL})) AS n_dead, count(*) AS n_fn FROM n WHERE kind IN ('function', 'method') GROUP BY 1)
SELECT repo, n_files, n_defs, longest, mean_length, n_god_files, {r6('100.0 * n_dead / n_fn', 2)} AS dead_share FROM q JOIN dd USING (repo)""")
def code_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: lengths of definitions, files that hold too much, and the share of functions nothing refers to."""
    d = defs(spark, sf_dir)
    size = F.col("end_line") - F.col("start_line") + 1
    ln = d.groupBy("repo", "rel").agg(F.count(F.lit(1)).alias("n_defs"), F.max(size).alias("longest"), F.avg(size).alias("mean"))
    q = ln.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_defs").alias("n_defs"), F.max("longest").alias("longest"), half_up(F.avg("mean"), 3).alias("mean_length"),
        F.count_if((F.col("n_defs") >= 10) | (F.col("longest") >= 60)).alias("n_god_files"),
    )
    used = g.of_kinds(graph_edges(spark, sf_dir), g.DEPENDENCY).select(F.col("dst").alias("id")).distinct().withColumn("used", F.lit(True))
    fn = graph_nodes(spark, sf_dir).where(F.col("kind").isin("function", "method")).join(used, "id", "left")
    dd = fn.groupBy(F.col("repository_id").alias("repo")).agg(half_up(100.0 * F.count_if(F.col("used").isNull()) / F.count(F.lit(1)), 2).alias("dead_share"))
    return q.join(dd, "repo")


@query(f"""WITH {N} SELECT repository_id, count(*) FILTER (kind IN ('function', 'method') AND tested IS NOT NULL) AS assessable, count(*) FILTER (kind IN ('function', 'method') AND tested) AS ready,
CASE WHEN count(*) FILTER (kind IN ('function', 'method') AND tested IS NOT NULL) > 0 THEN {r6("100.0 * count(*) FILTER (kind IN ('function', 'method') AND tested) / count(*) FILTER (kind IN ('function', 'method') AND tested IS NOT NULL)", 0)} END AS score FROM n GROUP BY 1""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository, the share of functions that are tested among those of which it is known."""
    fn = F.col("kind").isin("function", "method")
    r = graph_nodes(spark, sf_dir).groupBy("repository_id").agg(F.count_if(fn & F.col("tested").isNotNull()).alias("assessable"), F.count_if(fn & F.col("tested")).alias("ready"))
    return r.withColumn("score", F.when(F.col("assessable") > 0, half_up(100.0 * F.col("ready") / F.col("assessable"), 0)))


@query(f"""WITH s AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS w, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders)
SELECT o_custkey, {r6('sum(o_totalprice * w) / sum(w)', 2)} AS estimate, count(*) AS n FROM s WHERE o_totalprice BETWEEN 0.33 * m AND 3 * m GROUP BY 1""")
def duration_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean per customer that weighs later orders more, over those of a size like its mean (0.33 to 3 times)."""
    from graphloom.operators.skew import number_rows
    from graphloom.sources.tables import Scratch

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    m = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    x = number_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], Scratch(spark, "duration"), "orders").join(m, "o_custkey").where("o_totalprice between 0.33 * m and 3 * m")
    return x.groupBy("o_custkey").agg(half_up(ag.weighted_mean(F.col("o_totalprice"), F.col("_rn") + 1), 2).alias("estimate"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V_SQL} SELECT tool, {r6('median(value)', 3)} AS median, {r6("avg((outcome = 'complete')::INT)", 4)} AS pass_rate, {r6("avg((outcome = 'complete')::INT) FILTER (outcome <> 'miss')", 4)} AS pass_of_tried FROM v GROUP BY 1""")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and rates per tool; the rate among those tried leaves misses out."""
    ok = (F.col("outcome") == "complete").cast("int")
    return events(spark, sf_dir).groupBy("tool").agg(
        half_up(F.percentile("value", F.lit(0.5)), 3).alias("median"), half_up(F.avg(ok), 4).alias("pass_rate"), half_up(F.avg(F.when(F.col("outcome") != "miss", ok)), 4).alias("pass_of_tried")
    )


@query(f"""WITH {V_SQL}, a AS (SELECT user_id, max(value) AS best FROM v WHERE tool = 'click' GROUP BY 1), b AS (SELECT user_id, max(value) AS best FROM v WHERE tool = 'view' GROUP BY 1)
SELECT count(*) AS n_pairs, count(*) FILTER (b.best >= 100) AS base, CASE WHEN count(*) FILTER (b.best >= 100) > 0 THEN {r6('count(*) FILTER (a.best >= 100 AND b.best >= 100) / count(*) FILTER (b.best >= 100)', 4)} END AS ratio FROM a JOIN b USING (user_id)""")
def paired_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the users both arms have, each with its best try: how many of those the second arm solves the first solves too; null without any."""
    v = events(spark, sf_dir)
    a = v.where("tool = 'click'").groupBy("user_id").agg(F.max("value").alias("a"))
    b = v.where("tool = 'view'").groupBy("user_id").agg(F.max("value").alias("b"))
    base = F.count_if(F.col("b") >= 100)
    return a.join(b, "user_id").agg(F.count(F.lit(1)).alias("n_pairs"), base.alias("base"), F.when(base > 0, half_up(F.count_if((F.col("a") >= 100) & (F.col("b") >= 100)) / base, 4)).alias("ratio"))


@query("""SELECT n_regionkey, c_nationkey, count(DISTINCT o_custkey) AS n_projects, least(10 * count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END), 40) + least(5 * count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END), 30) + CASE WHEN bool_or(o_orderpriority LIKE '1%') THEN 20 ELSE 0 END AS score
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)""")
def exposure_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped additive score per nation, region and over all, in one rollup."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
    a, b = F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))), F.countDistinct(F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")))
    s = F.least(10 * a, F.lit(40)) + F.least(5 * b, F.lit(30)) + F.when(F.bool_or(F.col("o_orderpriority").startswith("1")), 20).otherwise(0)
    return o.rollup("n_regionkey", "c_nationkey").agg(F.countDistinct("o_custkey").alias("n_projects"), s.alias("score"))


@query("WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS k FROM lineitem GROUP BY 1) SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY k) AS first_l_orderkey FROM s")
def set_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the same set of suppliers, whatever the order of their lines, with the first of them."""
    return ag.same_sets(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")


@query(f"""WITH {V_SQL} SELECT user_id, arg_max(outcome, CASE outcome WHEN 'complete' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS state, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools FROM v GROUP BY 1""")
def reach_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the highest state of all reports and the union of their tools."""
    rank = F.when(F.col("outcome") == "complete", 2).when(F.col("outcome") == "partial", 1).otherwise(0)
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("outcome", rank).alias("state"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))


_OLD = ("baseline-kit", "digest-kit", "fact-kit", "hub-kit")


@query(f"WITH {F_SQL}, {M_SQL} SELECT repo, array_to_string(list_sort(list(DISTINCT spec)), ',') AS flagged FROM mr WHERE spec IN {_OLD} GROUP BY 1")
def dependency_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository, the packages it uses out of a fixed set of deprecated ones."""
    m = module_resolution(spark, sf_dir).where(F.col("spec").isin(*_OLD))
    return m.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("spec")), ",").alias("flagged"))


@query("""WITH s AS (SELECT o_custkey AS project, count(*) AS n, sum(o_totalprice) AS total, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1),
t AS (SELECT project, CASE WHEN (n <= 5)::INT + (total <= 600000)::INT + (kinds <= 3)::INT >= 2 THEN 'nano' WHEN (n <= 10)::INT + (total <= 1500000)::INT + (kinds <= 4)::INT >= 2 THEN 'small' ELSE 'standard' END AS tier FROM s)
SELECT v.tier, count(t.tier) AS n FROM (VALUES ('nano'), ('small'), ('standard')) v(tier) LEFT JOIN t ON t.tier = v.tier GROUP BY 1""")
def tier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by size, where two of three measures decide; all tiers are present."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.countDistinct("o_orderpriority").alias("kinds"))

    def two(n, total, kinds):
        return (F.col("n") <= n).cast("int") + (F.col("total") <= total).cast("int") + (F.col("kinds") <= kinds).cast("int") >= 2

    t = s.select(F.when(two(5, 600000, 3), "nano").when(two(10, 1500000, 4), "small").otherwise("standard").alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([("nano",), ("small",), ("standard",)], "tier string").join(t, "tier", "left").fillna(0, ["n"])
