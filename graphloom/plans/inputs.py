"""Queries of discovery, outlines, exports, bills of material and the streaming ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.numbers import half_up
from graphloom.functions.paths import clean_path, extension, is_test_file, skipped
from graphloom.plans.graph import _SQL_TEST
from graphloom.plans.timeline import V_SQL
from graphloom.plans.views import E, N, graph_edges, graph_nodes, p, r6
from graphloom.sinks import export
from graphloom.sources.tables import Scratch, table
from graphloom.streaming import ledger

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Kinds of project documents and the paths that tell them, first match wins.
DOC_KINDS = (
    ("readme", r"(^|/)readme[^/]*$"), ("changelog", r"(^|/)(changelog|history|changes)[^/]*$"), ("license", r"(^|/)(license|licence|copying)[^/]*$"), ("contributing", r"(^|/)(contributing|code_of_conduct)[^/]*$"),
    ("security", r"(^|/)security[^/]*$"), ("ci", r"(^|/)\.github/|(^|/)\.gitlab-ci|(^|/)jenkinsfile$"), ("docker", r"(^|/)(dockerfile|docker-compose|containerfile)[^/]*$"),
    ("manifest", r"(^|/)(package\.json|cargo\.toml|go\.mod|pyproject\.toml|gemfile|pom\.xml)$"), ("api", r"(openapi|swagger|api)"), ("adr", r"(^|/)(adr|decisions)/"), ("guide", r"(guide|tutorial|howto)"), ("docs", r"(^|/)docs?/"),
)


def doc_kind(path: F.Column) -> F.Column:
    out = F.lit("other")
    for k, rx in reversed(DOC_KINDS):
        out = F.when(F.lower(path).rlike(rx), k).otherwise(out)
    return F.when(path.isNotNull(), out)


_KIND_SQL = "CASE " + " ".join("WHEN regexp_matches(lower(doc_path), '{0}') THEN '{1}'".format(rx, k) for k, rx in DOC_KINDS) + " WHEN doc_path IS NOT NULL THEN 'other' END"
_SKIP_SQL = "regexp_matches({0}, '(^|/)(node_modules|dist|build|out|target|vendor|coverage|bin|obj|venv|env|__pycache__|site-packages|bower_components)/|(^|/)\\.[^/]+/')"


@query(f"""WITH t AS (SELECT DISTINCT repository_id, {p('rel')} AS rel FROM parse_tasks WHERE rel IS NOT NULL), x AS (SELECT *, lower(regexp_extract(regexp_replace(rel, '^.*/', ''), '^.+\\.([A-Za-z0-9]+)$', 1)) AS ext FROM t)
SELECT repository_id, rel, ext, {_SQL_TEST.format('rel')} AS is_test, {_SKIP_SQL.format('rel')} AS is_skipped FROM x WHERE ext <> ''""")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file a task names with its extension, whether it is a test, and whether discovery would skip its directory."""
    t = table(spark, sf_dir, "parse_tasks").where("rel is not null").select("repository_id", clean_path("rel").alias("rel")).distinct()
    f = F.col("rel")
    return t.select("repository_id", "rel", extension(f).alias("ext"), is_test_file(f).alias("is_test"), skipped(f).alias("is_skipped")).where("ext <> ''")


@query(f"SELECT doc_id, doc_path, {_KIND_SQL} AS kind FROM (SELECT DISTINCT doc_id, doc_path FROM documents)")
def doc_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of project document every path is."""
    d = table(spark, sf_dir, "documents").select("doc_id", "doc_path").distinct()
    return d.withColumn("kind", doc_kind(F.col("doc_path")))


@query("WITH h AS (SELECT abs, max(row(read_at, sha256(content))) AS x FROM source_files WHERE abs IS NOT NULL AND content IS NOT NULL AND read_at IS NOT NULL GROUP BY 1), r AS (SELECT string_split(abs, '/')[4] AS repository, sha256(abs || ':' || x[2]) AS k FROM h) SELECT repository, count(*) AS n_files, sha256((sum(('0x' || substr(k, 1, 13))::BIGINT))::VARCHAR || ',' || (sum(('0x' || substr(k, 14, 13))::BIGINT))::VARCHAR) AS corpus_hash FROM r GROUP BY 1")
def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash per repository over the hashes of its files' contents, whatever their order."""
    s = table(spark, sf_dir, "source_files").where("abs is not null and content is not null and read_at is not null")
    h = s.select("abs", "read_at", F.sha2("content", 256).alias("hash")).groupBy("abs").agg(F.max(F.struct("read_at", "hash")).alias("x"))
    k = h.select(F.try_element_at(F.split("abs", "/"), F.lit(4)).alias("repository"), F.sha2(F.concat_ws(":", "abs", "x.hash"), 256).alias("k"))
    sums = [F.sum(F.conv(F.substring("k", 1 + 13 * i, 13), 16, 10).cast("decimal(30,0)")).cast("string") for i in range(2)]
    return k.groupBy("repository").agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.concat_ws(",", *sums), 256).alias("corpus_hash"))


# How a definition starts on a line, per extension (the tier below a parser).
OUTLINE = {
    "py": r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)", "rb": r"^\s*(?:def|class|module)\s+(?:self\.)?([A-Za-z_]\w*)", "go": r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)([A-Za-z_]\w*)",
    "rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait)\s+([A-Za-z_]\w*)", "java": r"^\s*(?:public|protected|private)?\s*(?:static\s+|final\s+|abstract\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "ts": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)", "js": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class)\s+([A-Za-z_$][\w$]*)",
}


def outline(files: DataFrame) -> DataFrame:
    """(abs, line, name) of the definitions that the lines of texts (abs, ext, content) begin, by the pattern of their extension."""
    l = files.where("content is not null").select("abs", "ext", F.posexplode(F.split("content", "\n")).alias("i", "s"))
    name = F.lit("")
    for ext, rx in OUTLINE.items():
        name = F.when(F.col("ext") == ext, F.regexp_extract("s", rx, 1)).otherwise(name)
    return l.select("abs", (F.col("i") + 1).alias("line"), name.alias("name")).where("name <> ''")


_EXT_SQL = "lower(regexp_extract(abs, '\\.([A-Za-z0-9]+)$', 1))"
_OUT_SQL = "CASE ext " + " ".join(f"WHEN '{e}' THEN regexp_extract(s, '{rx}', 1)" for e, rx in OUTLINE.items()) + " ELSE '' END"


@query(f"""WITH c AS (SELECT abs, max(content) AS content FROM source_files WHERE abs IS NOT NULL AND content IS NOT NULL GROUP BY 1), l AS (SELECT abs, {_EXT_SQL} AS ext, unnest(string_split(content, E'\\n')) AS s, generate_subscripts(string_split(content, E'\\n'), 1) AS line FROM c),
o AS (SELECT abs, line, {_OUT_SQL} AS name FROM l) SELECT abs, line, name FROM o WHERE name <> ''""")
def source_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions of every file by the first-tier patterns."""
    c = table(spark, sf_dir, "source_files").where("abs is not null and content is not null").groupBy("abs").agg(F.max("content").alias("content"))
    o = outline(c.withColumn("ext", F.lower(F.regexp_extract("abs", r"\.([A-Za-z0-9]+)$", 1))))
    return o.select("abs", F.col("line").cast("long").alias("line"), "name")


_Q = "'\"' || replace(replace(coalesce({0}, ''), '\\', '\\\\'), '\"', '\\\"') || '\"'"
_X = "replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_S = "CASE WHEN {0} IS NULL THEN 'NULL' ELSE '''' || replace({0}, '''', '''''') || '''' END"


@query(f"""WITH {E}, {N}, x AS (
SELECT 'dot' AS format, '  ' || {_Q.format('id')} || ' [label=' || {_Q.format('name')} || '];' AS value FROM n UNION ALL SELECT 'dot', '  ' || {_Q.format('src')} || ' -> ' || {_Q.format('dst')} || ' [label=' || {_Q.format('kind')} || '];' FROM e
UNION ALL SELECT 'cypher', 'CREATE (:Node {{id: ' || {_Q.format('id')} || ', kind: ' || {_Q.format('kind')} || ', name: ' || {_Q.format('name')} || '}});' FROM n UNION ALL SELECT 'cypher', 'MATCH (a:Node {{id: ' || {_Q.format('src')} || '}}), (b:Node {{id: ' || {_Q.format('dst')} || '}}) CREATE (a)-[:' || upper(kind) || ']->(b);' FROM e
UNION ALL SELECT 'sql', 'INSERT INTO nodes VALUES (' || concat_ws(', ', {_S.format('id')}, {_S.format('kind')}, {_S.format('name')}, {_S.format('file')}) || ');' FROM n UNION ALL SELECT 'sql', 'INSERT INTO edges VALUES (' || concat_ws(', ', {_S.format('kind')}, {_S.format('src')}, {_S.format('dst')}) || ');' FROM e
UNION ALL SELECT 'graphml', '<node id="' || {_X.format('id')} || '"><data key="name">' || {_X.format('name')} || '</data></node>' FROM n UNION ALL SELECT 'graphml', '<edge source="' || {_X.format('src')} || '" target="' || {_X.format('dst')} || '"><data key="kind">' || {_X.format('kind')} || '</data></edge>' FROM e)
SELECT format, value FROM x""")
def export_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph as lines of four text formats."""
    n, e, out = graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), None
    for form in ("dot", "cypher", "sql", "graphml"):
        one = export.lines(n, e, form).select(F.lit(form).alias("format"), "value")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {N} SELECT id, CAST(json_object('type', 'node', 'id', id, 'kind', kind, 'name', name, 'file', file) AS VARCHAR) AS value FROM n WHERE kind IS NOT NULL AND name IS NOT NULL AND file IS NOT NULL""")
def export_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node as a line of JSON."""
    n = graph_nodes(spark, sf_dir).where("kind is not null and name is not null and file is not null")
    return n.select("id", export.node_line("ndjson").alias("value"))


@query("""WITH c AS (SELECT DISTINCT source_type AS ecosystem, lib_name AS name, lib_version AS version FROM lib_entries WHERE source_type IS NOT NULL AND lib_name IS NOT NULL AND lib_version IS NOT NULL)
SELECT CAST(json_object('type', 'library', 'name', name, 'version', version, 'purl', 'pkg:' || ecosystem || '/' || name || '@' || version) AS VARCHAR) AS value FROM c""")
def sbom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every library as a component of a bill of materials."""
    c = table(spark, sf_dir, "lib_entries").select(F.col("source_type").alias("ecosystem"), F.col("lib_name").alias("name"), F.col("lib_version").alias("version")).where("ecosystem is not null and name is not null and version is not null").distinct()
    return export.cyclonedx(c)


@query("""WITH a AS (SELECT repository_id, lib_name, max(lib_version) AS v FROM lib_entries WHERE added_at < TIMESTAMPTZ '2026-05-01 00:00:00+00' GROUP BY 1, 2), b AS (SELECT repository_id, lib_name, max(lib_version) AS v FROM lib_entries GROUP BY 1, 2)
SELECT repository_id, lib_name, a.v AS old, b.v AS new, CASE WHEN a.lib_name IS NULL THEN 'added' WHEN b.lib_name IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (repository_id, lib_name)""")
def sbom_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The libraries of every repository on a stated day against now."""
    from graphloom.operators.joins import snapshot_diff

    t = table(spark, sf_dir, "lib_entries").where("repository_id is not null and lib_name is not null")
    a = t.where(F.col("added_at") < F.lit("2026-05-01 00:00:00").cast("timestamp")).groupBy("repository_id", "lib_name").agg(F.max("lib_version").alias("v"))
    b = t.groupBy("repository_id", "lib_name").agg(F.max("lib_version").alias("v"))
    return snapshot_diff(a, b, ["repository_id", "lib_name"], "v").select("repository_id", "lib_name", "old", "new", "status")


@query(f"""WITH {V_SQL} SELECT tool, count(*) AS calls, count(*) FILTER (outcome = 'complete') AS complete, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'miss') AS miss, epoch_us(max(ts)) AS last_us FROM v GROUP BY 1""")
def streaming_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by tool, kept by a stream over the events."""
    raw = ledger.tail_parquet(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    v = F.col("value")
    e = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.when(v >= 100, "complete").when(v >= 10, "partial").otherwise("miss").alias("outcome"))
    s = Scratch(spark, "stream")
    ledger.run_to_table(ledger.running_stats(e), s.path("stats"), s.path("checkpoint"))
    return spark.read.parquet(s.path("stats")).select("tool", "calls", "complete", "partial", "miss", F.unix_micros("last_at").alias("last_us"))


@query(f"""WITH d AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k), {V_SQL}, w AS (SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS started, tool, tokens FROM v, d) SELECT epoch_us(started) AS started_us, tool, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, {r6('sum(tokens) / count(*)', 2)} AS mean FROM w GROUP BY 1, 2""")
def sliding_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens by tool in weeks that start every day; the same aggregate that the stream runs under a watermark."""
    from graphloom.plans.timeline import events

    w = ledger.windowed(events(spark, sf_dir))
    return w.select(F.unix_micros("window.start").alias("started_us"), "tool", "calls", "tokens", half_up(F.col("tokens") / F.col("calls"), 2).alias("mean"))
