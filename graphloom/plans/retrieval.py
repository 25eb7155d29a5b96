"""Queries of the retrieval and text families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.numbers import half_up
from graphloom.operators import graph as g
from graphloom.operators import retrieval as rt
from graphloom.plans.resolve import F_SQL, M_SQL, module_resolution
from graphloom.plans.views import E, N, graph_edges, graph_nodes, r6
from graphloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
# the stated questions
QUESTIONS = ("where is the frozen token budget parsed", "how does the stale graph cursor get updated", "queue digest of the shared route module")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def terms_of(question: str) -> list[tuple[str, bool]]:
    """(term, weak) of a question."""
    import re

    words = dict.fromkeys(w for w in re.split(r"[^\w]+|_", question.lower()) if w and w not in tx.STOPWORDS)
    return [(w, w in tx.WEAK) for w in words]


ALL_TERMS = list(dict.fromkeys(t for q in QUESTIONS for t, _ in terms_of(q)))
_PARTS = "list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


@query(f"WITH {N} SELECT id, array_to_string(list_sort({_PARTS.format('name')}), ' ') AS parts FROM n WHERE name IS NOT NULL")
def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every node's name."""
    n = graph_nodes(spark, sf_dir).where("name is not null")
    return n.select("id", F.array_join(F.array_sort(tx.identifier_parts(F.col("name"))), " ").alias("parts"))


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


@query(f"""SELECT doc_id, count(*) AS n_rows, max(len(list_filter(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')), lambda x: x <> '' AND NOT list_contains({_STOP}, x)))) AS n_terms,
max(CAST(ceil(length(text) / 4) AS BIGINT)) AS approx_tokens FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms and estimated tokens of every document."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(tx.tokens(F.col("text")))).cast("long").alias("n_terms"), F.max(tx.approx_tokens(F.col("text"))).alias("approx_tokens"))


_VOCAB = f"v AS (SELECT *, {_PARTS.format('name')} AS parts FROM n WHERE kind NOT IN ('file', 'external') AND name IS NOT NULL)"
_IDF = "i AS (SELECT t.term, count(*) FILTER (list_contains(parts, t.term) OR contains(lower(name), t.term)) AS df, " + r6("greatest(0.5, least(8, ln((count(*) + 1) / (count(*) FILTER (list_contains(parts, t.term) OR contains(lower(name), t.term)) + 1)) + 1))") + " AS weight FROM v, (VALUES {0}) t(term) GROUP BY 1)"


@query(f"WITH {N}, {_VOCAB}, {_IDF.format(', '.join(f'({t!r})' for t in ALL_TERMS))} SELECT term, df, weight FROM i")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How telling each term of the questions is among the names of the graph."""
    return rt.idf(_symbols(spark, sf_dir), ALL_TERMS)


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_nodes(spark, sf_dir).where(~F.col("kind").isin("file", "external") & F.col("name").isNotNull()).select("id", "kind", "name", "qname", "file", "importance", "signature", "doc", "span_start")


_NEED = "greatest(5, CAST(ceil(0.6 * least(length(p), length(t.term))) AS INT))"
_LEX = f"""{N}, {_VOCAB}, {_IDF.format(', '.join(f'({t!r})' for t in ALL_TERMS))},
q AS (SELECT * FROM (VALUES {', '.join(f"({k}, {t!r}, {'true' if w else 'false'})" for k, x in enumerate(QUESTIONS) for t, w in terms_of(x))}) q(question, term, weak)),
h AS (SELECT t.question, v.id, t.weak, i.weight * CASE WHEN t.weak THEN 0.25 ELSE 1 END * CASE WHEN lower(name) = t.term THEN 10 WHEN list_contains(parts, t.term) THEN 6 WHEN contains(lower(name), t.term) THEN 4 WHEN contains(lower(qname), t.term) THEN 3
 WHEN len(list_filter(parts, lambda p: length(p) >= {_NEED} AND length(t.term) >= {_NEED} AND left(p, {_NEED}) = left(t.term, {_NEED}))) > 0 THEN 2
 WHEN contains(file, '/') AND list_contains(string_split(lower(regexp_replace(file, '/[^/]*$', '')), '/'), t.term) THEN 2 WHEN contains(lower(file), t.term) THEN 1 ELSE 0 END AS s FROM v, q t JOIN i ON i.term = t.term),
a AS (SELECT question, id, sum(s) AS s, count(*) FILTER (s > 0 AND NOT weak) AS hits FROM h GROUP BY 1, 2),
lx AS (SELECT question, id, {r6('s * (1 + 0.35 * least(hits - 1, 4)) * (1 + 0.4 * coalesce(importance, 0))')} AS score FROM a JOIN n USING (id) WHERE hits > 0)"""


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question, id, name, ..., score) of the stated questions."""
    s = _symbols(spark, sf_dir)
    # one row for each term of the questions
    weight = {r["term"]: r["weight"] for r in rt.idf(s, ALL_TERMS).collect()}
    out = None
    for k, q in enumerate(QUESTIONS):
        one = rt.lexical(s, [(t, weight[t], weak) for t, weak in terms_of(q)]).withColumn("question", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_LEX} SELECT question, id, {r6('score', 4)} AS score, row_number() OVER (PARTITION BY question ORDER BY {r6('score', 4)} DESC, id) AS rank FROM lx QUALIFY row_number() OVER (PARTITION BY question ORDER BY {r6('score', 4)} DESC, id) <= 25")
def lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nodes that answer each question best by their words."""
    s = _lexical(spark, sf_dir).withColumn("score", half_up(F.col("score"), 4))
    return g.top_per_key(s, ["question"], [F.desc("score"), "id"], 25).select("question", "id", "score", "rank")


@query(f"""WITH {_LEX}, {E}, t AS (SELECT question, id, {r6('score', 4)} AS score, row_number() OVER (PARTITION BY question ORDER BY {r6('score', 4)} DESC, id) AS rank FROM lx QUALIFY row_number() OVER (PARTITION BY question ORDER BY {r6('score', 4)} DESC, id) <= 12),
b AS (SELECT t.question, t.id, t.rank, CAST(ceil((length(qname) + coalesce(length(signature), 0) + 40) / 4) AS BIGINT) AS cost FROM t JOIN n USING (id)), c AS (SELECT *, sum(cost) OVER (PARTITION BY question ORDER BY rank) AS used FROM b)
SELECT question, id, rank, CAST(used AS BIGINT) AS used, (SELECT count(DISTINCT src) FROM e WHERE e.dst = c.id AND kind IN ('call', 'references')) AS n_callers FROM c WHERE rank = 1 OR used <= 200""")
def orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds of each question with their callers, as many as a budget of 200 tokens holds, at least one."""
    s = _lexical(spark, sf_dir).withColumn("score", half_up(F.col("score"), 4))
    t = g.top_per_key(s, ["question"], [F.desc("score"), "id"], 12)
    cost = F.ceil((F.length("qname") + F.coalesce(F.length("signature"), F.lit(0)) + 40) / F.lit(4))
    from pyspark.sql import Window

    # at most 12 rows a question
    w = Window.partitionBy("question").orderBy("rank")
    t = t.withColumn("used", F.sum(cost).over(w)).where("rank = 1 or used <= 200")
    c = g.of_kinds(graph_edges(spark, sf_dir), g.USAGE).groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n_callers"))
    return t.join(c, "id", "left").fillna(0, ["n_callers"]).select("question", "id", "rank", "used", "n_callers")


_NEEDLES = ("freezeCallsite", "FREEZECALLSITE", "budget", "platform/config/schema.ts")


def _cascade_sql(x: str) -> str:
    return f"""(SELECT {x!r} AS needle, id, tier FROM (SELECT id, name, CASE WHEN id = lower({x!r}) THEN 1 WHEN file = {x!r} THEN 2 WHEN qname = {x!r} THEN 3 WHEN name = {x!r} THEN 4 WHEN lower(name) = lower({x!r}) THEN 5 WHEN contains(lower(name), lower({x!r})) THEN 6 END AS tier FROM n) WHERE tier = (SELECT min(CASE WHEN id = lower({x!r}) THEN 1 WHEN file = {x!r} THEN 2 WHEN qname = {x!r} THEN 3 WHEN name = {x!r} THEN 4 WHEN lower(name) = lower({x!r}) THEN 5 WHEN contains(lower(name), lower({x!r})) THEN 6 END) FROM n) ORDER BY name, id LIMIT 25)"""


@query(f"WITH {N} " + " UNION ALL ".join(_cascade_sql(x) for x in _NEEDLES))
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stated names mean: the first way of looking that finds any node wins."""
    n, out = graph_nodes(spark, sf_dir), None
    for x in _NEEDLES:
        one = rt.cascade(n, x).select(F.lit(x).alias("needle"), "id", "tier")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {N} SELECT id, name, CASE WHEN lower(name) = 'queue' THEN 0 WHEN starts_with(lower(name), 'queue') THEN 1 ELSE 2 END AS tier FROM n WHERE contains(lower(name), 'queue') ORDER BY tier, length(name), id LIMIT 40""")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like a word: equal, then starting with it, then holding it, shorter ones first."""
    low = F.lower("name")
    tier = F.when(low == "queue", 0).when(low.startswith("queue"), 1).otherwise(2)
    return graph_nodes(spark, sf_dir).where(low.contains("queue")).select("id", "name", tier.alias("tier")).orderBy("tier", F.length("name"), "id").limit(40)


@query(f"""WITH {N}, v AS (SELECT id, name, importance, {_PARTS.format('name')} AS parts FROM n WHERE name IS NOT NULL), h AS (SELECT id, name, coalesce(importance, 0) AS importance, len(list_intersect(parts, ['shared', 'route', 'queue'])) AS hits, lower(name) IN ('sharedroute', 'shared_route', 'sharedroutequeue', 'shared_route_queue') AS exact FROM v)
SELECT id, hits, exact FROM h WHERE exact OR hits >= 2 ORDER BY exact DESC, hits DESC, importance DESC, name, id LIMIT 100""")
def multi_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are several words put together, or hold two of them or more."""
    words = ("shared", "route", "queue")
    joined = [s.join(words[:k]) for k in (2, 3) for s in ("", "_")]
    v = graph_nodes(spark, sf_dir).where("name is not null")
    hits = F.size(F.array_intersect(tx.identifier_parts(F.col("name")), F.array(*map(F.lit, words))))
    v = v.select("id", "name", F.coalesce("importance", F.lit(0.0)).alias("importance"), hits.cast("long").alias("hits"), F.lower("name").isin(*joined).alias("exact"))
    return v.where("exact or hits >= 2").orderBy(F.desc("exact"), F.desc("hits"), F.desc("importance"), "name", "id").limit(100).select("id", "hits", "exact")


_LITERALS = ("retry budget", "span_val", "cursor.score")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS nr FROM (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1)),
k AS (SELECT * FROM (VALUES {', '.join(f'({x!r})' for x in ('budget', 'token', 'https://'))}) k(needle)) SELECT doc_id, needle, nr AS line FROM l JOIN k ON contains(lower(line), lower(needle))""")
def literal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document that holds one of the stated strings."""
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rt.literal_scan(d, "text", ("budget", "token", "https://"), ["doc_id"]).select("doc_id", "needle", F.col("line").cast("long").alias("line"))


@query(r"""WITH d AS (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, 'https?://[^\s"''`<>)]+'), list_transform(regexp_extract_all(text, '"[^"\n]{2,}"|`[^`\n]{2,}`'), lambda x: x[2:-2])))), ' | ') AS needles FROM d""")
def needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and quoted phrases of every document."""
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return d.select("doc_id", F.array_join(F.array_sort(tx.needles(F.col("text"))), " | ").alias("needles"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, """ + r6("list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[])") + """ AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    return rt.cosine_topk(e, e.where("vec_id % 50 = 0"), 10).select("query_id", "id", "score", "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS a, label AS l FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, """ + r6("list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[])") + """ AS score FROM q, embeddings WHERE vec_id <> query_id),
c AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50),
m AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM q JOIN embeddings ON label = l WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vec_id) <= 50)
SELECT query_id, id, """ + r6("sum(1.0::DOUBLE / (60 + rank))", 9) + """ AS score FROM (SELECT * FROM c UNION ALL SELECT * FROM m) GROUP BY 1, 2""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists of each query, by cosine and by label, fused by the reciprocals of their ranks."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0")
    c = rt.cosine_topk(e, q, 50).select("query_id", "id", "rank")
    m = q.select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("id <> query_id")
    return rt.fuse([c, g.top_per_key(m, ["query_id"], ["id"], 50).select("query_id", "id", "rank")], ["query_id", "id"])


@query(f"""WITH {N} SELECT id, sha256(concat_ws(' | ', kind, qname, file, signature, doc)) AS text_hash FROM n WHERE kind NOT IN ('file', 'external')""")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the text that stands for each node in a vector index."""
    n = graph_nodes(spark, sf_dir).where(~F.col("kind").isin("file", "external"))
    return n.select("id", F.sha2(F.concat_ws(" | ", "kind", "qname", "file", "signature", "doc"), 256).alias("text_hash"))


@query(f"""WITH {N}, a AS (SELECT id, sha256(concat_ws(' | ', kind, qname, file, signature, doc)) AS h FROM n WHERE kind NOT IN ('file', 'external')), b AS (SELECT id, sha256(concat_ws(' | ', kind, qname, file, signature, CASE WHEN importance > 0.5 THEN doc END)) AS h FROM n WHERE kind NOT IN ('file', 'external'))
SELECT a.id FROM a JOIN b USING (id) WHERE a.h <> b.h""")
def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose text differs from the one that was indexed before, and so must be embedded again."""
    n = graph_nodes(spark, sf_dir).where(~F.col("kind").isin("file", "external"))
    old = n.select("id", F.sha2(F.concat_ws(" | ", "kind", "qname", "file", "signature", F.when(F.col("importance") > 0.5, F.col("doc"))), 256).alias("text_hash"))
    return embed_text(spark, sf_dir).join(old, ["id", "text_hash"], "left_anti").select("id")


_BODY = "b AS (SELECT repository_id, doc_file, min(body) AS body FROM lib_docs WHERE body IS NOT NULL GROUP BY 1, 2)"
_SEC = f"""{_BODY}, l AS (SELECT repository_id, doc_file, unnest(string_split(body, E'\\n')) AS line, generate_subscripts(string_split(body, E'\\n'), 1) AS nr FROM b),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}[ \\t\\r\\f\\v]+[^\\s]') THEN 1 ELSE 0 END AS head FROM l), s AS (SELECT *, sum(head) OVER (PARTITION BY repository_id, doc_file ORDER BY nr ROWS UNBOUNDED PRECEDING) AS sec FROM h),
g AS (SELECT repository_id, doc_file, sec, coalesce(max(trim(regexp_extract(line, '^#{{1,6}}[ \\t\\r\\f\\v]+(.*[^\\s])[\\s]*$', 1), E' ')) FILTER (head = 1), '') AS heading, coalesce(max(length(regexp_extract(line, '^(#{{1,6}})', 1))) FILTER (head = 1), 0) AS level,
regexp_replace(coalesce(string_agg(line, E'\\n' ORDER BY nr) FILTER (head = 0), ''), '^\\s+|\\s+$', '', 'g') AS body FROM s GROUP BY 1, 2, 3),
sc AS (SELECT *, row_number() OVER (PARTITION BY repository_id, doc_file ORDER BY sec) - 1 AS pos FROM g WHERE heading <> '' OR body <> '')"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lib_docs").where("body is not null").groupBy("repository_id", "doc_file").agg(F.min("body").alias("body"))
    return b.select("repository_id", "doc_file", F.posexplode(tx.sections(F.col("body"))).alias("pos", "s")).select("repository_id", "doc_file", "pos", "s.heading", "s.level", "s.body")


@query(f"WITH {_SEC} SELECT repository_id, doc_file, pos, heading, CAST(level AS BIGINT) AS level, length(body) AS n_chars FROM sc")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of every library doc."""
    return _sections(spark, sf_dir).select("repository_id", "doc_file", F.col("pos").cast("long").alias("pos"), "heading", F.col("level").cast("long").alias("level"), F.length("body").cast("long").alias("n_chars"))


_TERMS = ["budget", "cursor", "token"]
_SYMS = ["freezeCallsite", "build_span"]
_SCORE = (
    f"CASE WHEN regexp_matches(heading, '{tx.USAGE}') THEN 4.0 ELSE 0 END + CASE WHEN regexp_matches(heading, '{tx.PREAMBLE}') THEN -6.0 ELSE 0 END"
    " + CASE WHEN len(regexp_extract_all(body, '```')) // 2 > 0 THEN 3 + 0.5 * least(len(regexp_extract_all(body, '```')) // 2, 5) ELSE 0 END"
    + "".join(f" + CASE WHEN contains(lower(heading || E'\\n' || body), '{t}') THEN 5 ELSE 0 END" for t in _TERMS)
    + "".join(f" + CASE WHEN contains(lower(heading || E'\\n' || body), '{t.lower()}') THEN 2 ELSE 0 END" for t in _SYMS)
    + " - 0.1 * pos + CASE WHEN len(regexp_extract_all(body, '\\]\\(|https?://')) / greatest(len(list_filter(string_split(body, E'\\n'), lambda x: trim(x, ' ') <> '')), 1) > 0.5 THEN -3 ELSE 0 END"
)


@query(f"WITH {_SEC} SELECT repository_id, doc_file, pos, {r6(_SCORE, 4)} AS score FROM sc")
def section_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every section is worth to a stated question."""
    s = _sections(spark, sf_dir)
    score = tx.section_score(F.col("heading"), F.col("body"), F.col("pos"), _TERMS, _SYMS)
    return s.select("repository_id", "doc_file", F.col("pos").cast("long").alias("pos"), half_up(score, 4).alias("score"))


_CODE = "(contains(body, '```') OR regexp_matches(body, '(^|\\n)( {4}|\\t)\\S'))"
_HITS = " + ".join(f"contains(lower(body), '{t}')::INT" for t in _TERMS)


@query(f"""WITH {_BODY}, q AS (SELECT *, {_CODE} AS code, ceil(length(body) / 4) >= 60 AS long, {_HITS} AS hits FROM b)
SELECT repository_id, doc_file, 2 * code::INT + long::INT + contains(lower(body), 'kit')::INT + CASE WHEN hits >= 2 THEN least(hits, 2) ELSE 0 END AS score, code AND long AND hits >= 2 AS sufficient FROM q""")
def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every library doc is fit to answer the stated question."""
    b = table(spark, sf_dir, "lib_docs").where("body is not null").groupBy("repository_id", "doc_file").agg(F.min("body").alias("body"))
    return b.select("repository_id", "doc_file", tx.doc_quality(F.col("body"), F.lit("kit"), _TERMS).alias("q")).select("repository_id", "doc_file", "q.score", "q.sufficient")


@query(f"""WITH {_SEC}, x AS (SELECT repository_id, doc_file, pos, {r6(_SCORE, 4)} AS score, CAST(ceil((length(heading) + length(body)) / 4) AS BIGINT) AS cost FROM sc), r AS (SELECT *, row_number() OVER (PARTITION BY repository_id, doc_file ORDER BY score DESC, pos) AS rn FROM x)
SELECT repository_id, doc_file, count(*) AS n_sections, CAST(sum(cost) AS BIGINT) AS cost, max(score) AS best FROM r WHERE rn <= 5 GROUP BY 1, 2""")
def doc_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best sections of every doc: how many, what they cost, and the best score."""
    s = _sections(spark, sf_dir)
    x = s.select("repository_id", "doc_file", "pos", half_up(tx.section_score(F.col("heading"), F.col("body"), F.col("pos"), _TERMS, _SYMS), 4).alias("score"), F.ceil((F.length("heading") + F.length("body")) / F.lit(4)).alias("cost"))
    t = g.top_per_key(x, ["repository_id", "doc_file"], [F.desc("score"), "pos"], 5)
    return t.groupBy("repository_id", "doc_file").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("cost").alias("cost"), F.max("score").alias("best"))


def _sql_pattern(x: str) -> str:
    return x.replace("'", "''").replace("\\z", "$")


_RED = "expr"
for _p in tx.SECRETS:
    _RED = f"regexp_replace({_RED}, '{_sql_pattern(_p)}', '[REDACTED]', 'g')"


@query(f"""WITH {F_SQL}, x AS (SELECT DISTINCT repo, rel, unnest(list_concat(list_transform(parse.guards, lambda g: g.expr), list_transform(parse.defs, lambda d: d.signature))) AS expr FROM f WHERE parse.guards IS NOT NULL AND parse.defs IS NOT NULL)
SELECT repo, rel, sha256({_RED}) AS text_hash, {_RED} <> expr AS redacted FROM x WHERE expr IS NOT NULL""")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards and signatures with credential-shaped runs replaced, and whether any was."""
    from graphloom.plans.resolve import parses

    x = parses(spark, sf_dir).where("parse.guards is not null and parse.defs is not null")
    x = x.select("repo", "rel", F.explode(F.concat(F.col("parse.guards.expr"), F.col("parse.defs.signature"))).alias("expr")).where("expr is not null").distinct()
    return x.select("repo", "rel", F.sha2(tx.redact(F.col("expr")), 256).alias("text_hash"), (tx.redact(F.col("expr")) != F.col("expr")).alias("redacted"))


_SIG = "[" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in tx.SIGNALS.items()) + "]"


@query(f"WITH d AS (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id, array_to_string(list_filter({_SIG}, lambda x: x IS NOT NULL), ',') AS labels FROM d")
def signal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaking signals every document holds."""
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return d.select("doc_id", F.array_join(tx.signals(F.col("text")), ",").alias("labels"))


def _vector() -> F.Column:
    def pick(k: str, letters: str, c: F.Column) -> F.Column:
        return F.concat(F.lit(f"/{k}:"), F.substring(F.lit(letters), c.cast("int") + 1, F.lit(1)))

    k, s = F.col("p_partkey"), F.col("p_size")
    return F.concat(
        F.lit("CVSS:3.1"), pick("AV", "NALP", k % 4), pick("AC", "LH", s % 2), pick("PR", "NLH", k % 3), pick("UI", "NR", F.floor(k / 4) % 2), pick("S", "UC", F.floor(k / 8) % 2),
        pick("C", "NLH", s % 3), pick("I", "NLH", F.floor(s / 3) % 3), pick("A", "NLH", F.floor(k / 16) % 3),
    )


_C = ["CASE (CAST(floor(p_partkey / 16) AS BIGINT) % 3)", "CASE (p_size % 3)", "CASE (CAST(floor(p_size / 3) AS BIGINT) % 3)"]
_CVSS = f"""x AS (SELECT p_partkey, CAST(floor(p_partkey / 8) AS BIGINT) % 2 = 1 AS ch, CASE p_partkey % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.62 WHEN 2 THEN 0.55 ELSE 0.2 END::DOUBLE AS av, CASE p_size % 2 WHEN 0 THEN 0.77 ELSE 0.44 END::DOUBLE AS ac,
p_partkey % 3 AS prk, CASE CAST(floor(p_partkey / 4) AS BIGINT) % 2 WHEN 0 THEN 0.85 ELSE 0.62 END::DOUBLE AS ui, {_C[1]} WHEN 0 THEN 0 WHEN 1 THEN 0.22 ELSE 0.56 END::DOUBLE AS c, {_C[2]} WHEN 0 THEN 0 WHEN 1 THEN 0.22 ELSE 0.56 END::DOUBLE AS i, {_C[0]} WHEN 0 THEN 0 WHEN 1 THEN 0.22 ELSE 0.56 END::DOUBLE AS a FROM part),
y AS (SELECT *, CASE prk WHEN 0 THEN 0.85 WHEN 1 THEN CASE WHEN ch THEN 0.68 ELSE 0.62 END ELSE CASE WHEN ch THEN 0.5 ELSE 0.27 END END::DOUBLE AS pr, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM x),
z AS (SELECT *, CASE WHEN ch THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS imp, 8.22::DOUBLE * av * ac * pr * ui AS ex FROM y),
w AS (SELECT p_partkey, imp, floor(least(CASE WHEN ch THEN 1.08::DOUBLE * (imp + ex) ELSE imp + ex END, 10) * 100000 + 0.5) AS r FROM z),
cv AS (SELECT p_partkey, CASE WHEN imp <= 0 THEN 0 WHEN CAST(r AS BIGINT) % 10000 = 0 THEN r / 100000 ELSE (floor(r / 10000) + 1) / 10 END AS score FROM w)"""


@query(f"WITH {_CVSS} SELECT p_partkey, score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'moderate' WHEN score > 0 THEN 'low' ELSE 'unknown' END AS severity FROM cv")
def cvss_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and severity of a vector made from every part."""
    return table(spark, sf_dir, "part").select("p_partkey", tx.cvss3(_vector()).alias("score")).withColumn("severity", tx.severity(F.col("score")))


@query(f"WITH {_CVSS} SELECT p_partkey, score FROM cv WHERE score >= 7")
def severity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose severity is high at least."""
    c = cvss_score(spark, sf_dir)
    return c.where(tx.severity_rank(F.col("severity")) >= 3).select("p_partkey", "score")


@query(f"""WITH {F_SQL}, {M_SQL}, k AS (SELECT mr.spec AS package, cl.callee, count(*) AS n FROM mr JOIN cl ON cl.repo = mr.repo AND cl.rel = mr.rel WHERE how = 'external' AND cl.qualified AND callee IS NOT NULL GROUP BY 1, 2)
SELECT package, array_to_string(list_slice(list_sort(list(callee)), 1, 20), ',') AS symbols, count(*) AS n_symbols FROM k GROUP BY 1""")
def contract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files that import a package call with a qualifier: the first 20 names and how many there are."""
    from graphloom.plans.resolve import calls

    m = module_resolution(spark, sf_dir).where("how = 'external'").select("repo", "rel", F.col("spec").alias("package"))
    k = m.join(calls(spark, sf_dir).where("qualified and callee is not null").select("repo", "rel", "callee").distinct(), ["repo", "rel"]).select("package", "callee").distinct()
    n = k.groupBy("package").agg(F.count(F.lit(1)).alias("n_symbols"))
    top = g.top_per_key(k, ["package"], ["callee"], 20).groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("callee")), ",").alias("symbols"))
    return n.join(top, "package").select("package", "symbols", "n_symbols")
