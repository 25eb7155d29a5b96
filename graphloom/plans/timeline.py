"""Queries of the window family over lines, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.numbers import half_up
from graphloom.operators import timeline as tl
from graphloom.operators.graph import top_per_key
from graphloom.operators.joins import latest, snapshot_diff
from graphloom.operators.skew import number_rows, running_sum, with_previous
from graphloom.plans.views import r6
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


LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
_ORD = ", ".join(LINE)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a timeline of each part: its version is the supplier's number mod 50; affected from 10 up to 30."""
    l = table(spark, sf_dir, "lineitem").where("l_shipdate is not null")
    v = (F.col("l_suppkey") % 50).cast("int")
    return l.select("l_partkey", *LINE, v.alias("v"), ((v >= 10) & (v < 30)).alias("bad"))


L_SQL = f"l AS (SELECT l_partkey, {_ORD}, CAST(l_suppkey % 50 AS INT) AS v, l_suppkey % 50 >= 10 AND l_suppkey % 50 < 30 AS bad FROM lineitem WHERE l_shipdate IS NOT NULL)"
_W = f"(PARTITION BY l_partkey ORDER BY {_ORD})"


@query(f"WITH {L_SQL}, w AS (SELECT *, lag(v) OVER {_W} AS p, row_number() OVER {_W} AS rn FROM l) SELECT l_partkey, l_shipdate AS at, v AS version, p AS previous FROM w WHERE rn = 1 OR v <> p")
def version_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of every part's version in the order of time."""
    c = tl.changes(lines(spark, sf_dir), ["l_partkey"], LINE, "v", Scratch(spark, "timeline"))
    return c.select("l_partkey", F.col("l_shipdate").alias("at"), F.col("v").alias("version"), F.col("prev_v").alias("previous"))


@query(f"WITH {L_SQL}, w AS (SELECT *, lag(bad, 1, false) OVER {_W} AS p FROM l) SELECT l_partkey, l_shipdate AS at, v AS version, bad AS entered FROM w WHERE bad <> p")
def version_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every part's version enters or leaves the affected range."""
    c = tl.crossings(lines(spark, sf_dir), ["l_partkey"], LINE, "bad", Scratch(spark, "crossings"))
    return c.select("l_partkey", F.col("l_shipdate").alias("at"), F.col("v").alias("version"), "entered")


_EXP = f"""{L_SQL}, w AS (SELECT *, lag(bad, 1, false) OVER {_W} AS p FROM l), c AS (SELECT *, lead(l_shipdate) OVER {_W} AS nxt FROM w WHERE bad <> p),
x AS (SELECT l_partkey, l_shipdate AS started, nxt AS ended FROM c WHERE bad)"""


def _exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.exposures(lines(spark, sf_dir), ["l_partkey"], LINE, "l_shipdate", "bad", Scratch(spark, "exposure"))


@query(f"WITH {_EXP} SELECT l_partkey, started, ended, CASE WHEN ended IS NOT NULL THEN CAST(round((epoch_us(ended) - epoch_us(started)) / 864e8) AS BIGINT) END AS days FROM x")
def exposure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when to when every part's version was affected; open windows have no end."""
    days = F.round((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / F.lit(864e8)).cast("long")
    return _exposures(spark, sf_dir).select("l_partkey", "started", "ended", days.alias("days"))


@query(f"WITH {L_SQL}, g AS (SELECT l_partkey, arg_max(bad, row({_ORD})) AS last_bad FROM l GROUP BY 1), ok AS (SELECT l_partkey, max(row({_ORD})) AS o FROM l WHERE NOT bad GROUP BY 1) SELECT l.l_partkey, min(l_shipdate) AS introduced FROM l JOIN g USING (l_partkey) LEFT JOIN ok USING (l_partkey) WHERE last_bad AND (o IS NULL OR row({_ORD}) > o) GROUP BY 1")
def introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For parts that are affected now, when the run that still lasts began: the first row behind the last good one. Grouped, without a window."""
    l = lines(spark, sf_dir).withColumn("o", F.struct(*LINE))
    ok = l.where("not bad").groupBy("l_partkey").agg(F.max("o").alias("ok"))
    return l.where("bad").join(ok, "l_partkey", "left").where("ok is null or o > ok").groupBy("l_partkey").agg(F.min("l_shipdate").alias("introduced"))


@query(f"""WITH {_EXP}, y AS (SELECT x.*, CASE WHEN p_size >= 40 THEN 'critical' WHEN p_size >= 25 THEN 'high' WHEN p_size >= 10 THEN 'moderate' ELSE 'low' END AS severity,
(epoch_us(coalesce(ended, TIMESTAMP '2002-01-01')) - epoch_us(started)) / 864e8 AS days FROM x JOIN part ON p_partkey = l_partkey)
SELECT severity, count(*) AS n, count(*) FILTER (ended IS NULL) AS n_open, count(*) FILTER (days > CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 30 WHEN 'moderate' THEN 90 ELSE 180 END) AS n_late,
{r6('avg(days) FILTER (ended IS NOT NULL)', 3)} AS mean_days, max(CAST(round(days) AS BIGINT)) FILTER (ended IS NULL) AS oldest_open FROM y GROUP BY 1""")
def cra_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per severity: windows, open ones, those longer than the term, mean time to the end, and the oldest that is open, on a stated day."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    s = F.when(F.col("p_size") >= 40, "critical").when(F.col("p_size") >= 25, "high").when(F.col("p_size") >= 10, "moderate").otherwise("low")
    x = _exposures(spark, sf_dir).join(p, "l_partkey").withColumn("severity", s)
    end = F.coalesce(F.col("ended").cast("timestamp"), F.lit("2002-01-01 00:00:00").cast("timestamp"))
    x = x.withColumn("days", (F.unix_micros(end) - F.unix_micros(F.col("started").cast("timestamp"))) / F.lit(864e8))
    term = F.when(F.col("severity") == "critical", 15).when(F.col("severity") == "high", 30).when(F.col("severity") == "moderate", 90).otherwise(180)
    return x.groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ended").isNull()).alias("n_open"), F.count_if(F.col("days") > term).alias("n_late"),
        half_up(F.avg(F.when(F.col("ended").isNotNull(), F.col("days"))), 3).alias("mean_days"), F.max(F.when(F.col("ended").isNull(), F.round("days").cast("long"))).alias("oldest_open"),
    )


@query(f"""WITH w AS (SELECT *, lag(o_totalprice) OVER x AS p, lag(o_orderpriority) OVER x AS m FROM orders WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CASE WHEN m = o_orderpriority THEN {r6('o_totalprice - p', 2)} END AS delta FROM w""")
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's price less that of the customer's order before, null where its priority (the method) differs."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")
    p = with_previous(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice", "o_orderpriority"], Scratch(spark, "delta"), "orders")
    same = F.col("prev_o_orderpriority") == F.col("o_orderpriority")
    return p.select("o_orderkey", F.when(same, half_up(F.col("o_totalprice") - F.col("prev_o_totalprice"), 2)).alias("delta"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger: tool, client, outcome, tokens and time; ``ts`` as a timestamp."""
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("tool"), (F.col("user_id") % 5).alias("client"),
        F.when(v >= 100, "complete").when(v >= 10, "partial").otherwise("miss").alias("outcome"),
        F.when(F.col("event_id") % 7 != 0, v).alias("ms"), F.floor(v * 3).alias("tokens"), F.floor(v * 10).alias("baseline"), (F.col("user_id") % 3).alias("model"), v.alias("value"),
    )


V_SQL = """v AS (SELECT event_id, ts, user_id, event_type AS tool, user_id % 5 AS client, CASE WHEN value >= 100 THEN 'complete' WHEN value >= 10 THEN 'partial' ELSE 'miss' END AS outcome,
CASE WHEN event_id % 7 <> 0 THEN value END AS ms, CAST(floor(value * 3) AS BIGINT) AS tokens, CAST(floor(value * 10) AS BIGINT) AS baseline, user_id % 3 AS model, value FROM events)"""


@query(f"""WITH RECURSIVE {V_SQL}, s AS (SELECT user_id, event_id, ts, outcome, CASE WHEN outcome IS DISTINCT FROM lag(outcome) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, ts, outcome, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s), k AS (SELECT user_id, run, outcome, min(ts) AS ts FROM r GROUP BY 1, 2, 3
UNION ALL SELECT k.user_id, k.run, k.outcome, (SELECT min(r.ts) FROM r WHERE r.user_id = k.user_id AND r.run = k.run AND r.ts >= k.ts + INTERVAL 1 DAY) FROM k WHERE EXISTS (SELECT 1 FROM r WHERE r.user_id = k.user_id AND r.run = k.run AND r.ts >= k.ts + INTERVAL 1 DAY))
SELECT user_id, epoch_us(ts) AS at_us, outcome FROM k""")
def record_score_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that change their user's last kept outcome or come a day or more after it."""
    k = tl.kept(events(spark, sf_dir).select("user_id", "event_id", "ts", "outcome"), ["user_id"], ["ts", "event_id"], "ts", "outcome", 86400, Scratch(spark, "kept"))
    return k.select("user_id", F.unix_micros("ts").alias("at_us"), "outcome")


@query(f"WITH {V_SQL}, m AS (SELECT user_id, min(ts) AS t FROM v WHERE outcome = 'miss' GROUP BY 1) SELECT user_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM v LEFT JOIN m USING (user_id) WHERE t IS NULL OR ts < t GROUP BY 1")
def prefix_until_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, the events before the first miss and their tokens."""
    u = tl.until_first(events(spark, sf_dir), ["user_id"], "ts", F.col("outcome") == "miss")
    return u.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {V_SQL}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS nw FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user: events less than twelve hours apart."""
    s = tl.sessions(events(spark, sf_dir), "user_id", "ts", "12 hours")
    return s.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n")


@query(f"WITH {V_SQL} SELECT event_id, user_id, CAST(sum(tokens) OVER w AS BIGINT) AS tokens_so_far, CAST(sum(baseline) OVER w AS BIGINT) AS baseline_so_far FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def session_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of tokens and baseline per user, each event included."""
    scratch = Scratch(spark, "metering")
    e = events(spark, sf_dir).select("user_id", "ts", "event_id", "tokens", "baseline")
    a = running_sum(e, ["user_id"], ["ts", "event_id"], "tokens", scratch, "tokens").select("*", (F.col("_before") + F.col("tokens")).alias("tokens_so_far")).drop("_before", "_rn")
    b = running_sum(scratch.keep(a, "first"), ["user_id"], ["ts", "event_id"], "baseline", scratch, "baseline")
    return b.select("event_id", "user_id", F.col("tokens_so_far").cast("long"), (F.col("_before") + F.col("baseline")).cast("long").alias("baseline_so_far"))


@query("""WITH w AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER x AS used, row_number() OVER x AS rn FROM orders WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, o_orderkey FROM w WHERE rn = 1 OR used <= 500000""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first orders up to a sum of 500 000, at least one."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return tl.within_budget(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 500000.0, Scratch(spark, "budget")).select("o_custkey", "o_orderkey")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber, l_quantity) AS rn FROM lineitem),
g AS (SELECT l_orderkey, rn, l_partkey, CASE WHEN l_quantity <= 60 THEN l_quantity ELSE 0 END AS used, l_quantity <= 60 AS took FROM s WHERE rn = 1
UNION ALL SELECT s.l_orderkey, s.rn, s.l_partkey, CASE WHEN g.used + s.l_quantity <= 60 THEN g.used + s.l_quantity ELSE g.used END, g.used + s.l_quantity <= 60 FROM g JOIN s ON s.l_orderkey = g.l_orderkey AND s.rn = g.rn + 1)
SELECT l_orderkey, l_partkey, count(*) AS n FROM g WHERE took GROUP BY 1, 2""")
def budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every order a greedy pass by price takes within 60 units, others skipped."""
    l = table(spark, sf_dir, "lineitem")
    got = tl.greedy(l, ["l_orderkey"], ["l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"], "l_quantity", ["l_partkey"], F.lit(60.0))
    return got.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH w AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, {r6('1 - i / n', 2)} AS score FROM w")
def relative_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(1 - place / number) within each label, rounded to two places."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    n = number_rows(e, ["label"], ["vec_id"], Scratch(spark, "relative"), "places")
    k = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.join(k, "label").select("vec_id", "label", half_up(1 - F.col("_rn") / F.col("n"), 2).alias("score"))


@query("WITH w AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_retailprice > 0) SELECT p_partkey, rank FROM w")
def rank_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from 1 over all parts by price, without a task that sorts them all."""
    p = table(spark, sf_dir, "part").where("p_retailprice > 0").select("p_partkey", (-F.col("p_retailprice")).alias("k"))
    return number_rows(p, [], ["k", "p_partkey"], Scratch(spark, "ranks"), "ranks").select("p_partkey", (F.col("_rn") + 1).alias("rank"))


@query(f"WITH {V_SQL} SELECT tool, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM v WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1")
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens of the week before a stated day."""
    e = events(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-31 00:00:00").cast("timestamp") - F.expr("interval 7 days"))
    return e.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query("""WITH a AS (SELECT l_partkey, max(l_suppkey) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1), b AS (SELECT l_partkey, max(l_suppkey) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1)
SELECT l_partkey, a.v AS old, b.v AS new, CASE WHEN a.l_partkey IS NULL THEN 'added' WHEN b.l_partkey IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (l_partkey)""")
def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was added, removed, changed or left as it was between two halves of the lines."""
    l, day = table(spark, sf_dir, "lineitem"), F.lit("1998-06-01")
    a = l.where(F.col("l_shipdate") < day).groupBy("l_partkey").agg(F.max("l_suppkey").alias("v"))
    b = l.where(F.col("l_shipdate") >= day).groupBy("l_partkey").agg(F.max("l_suppkey").alias("v"))
    return snapshot_diff(a, b, ["l_partkey"], "v").select("l_partkey", "old", "new", "status")


@query("""WITH s AS (SELECT year(o_orderdate) AS y, o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1, 2), a AS (SELECT * FROM s WHERE y = 1996), b AS (SELECT * FROM s WHERE y = 1997),
x AS (SELECT o_custkey, a.p AS pa, b.p AS pb, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' WHEN a.p = b.p THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (o_custkey))
SELECT status, count(*) AS n, """ + r6("sum(pb - pa)", 2) + """ AS delta FROM x GROUP BY 1""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two years against each other: how many came, went, changed, and the sum of the changes."""
    s = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_custkey").agg(F.max("o_totalprice").alias("p"))
    d = snapshot_diff(s.where("y = 1996"), s.where("y = 1997"), ["o_custkey"], "p")
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum(F.col("new") - F.col("old")), 2).alias("delta"))


@query("""WITH s AS (SELECT l_partkey, date_trunc('year', l_shipdate) AS y, max(l_suppkey % 50) AS v FROM lineitem GROUP BY 1, 2) SELECT l_partkey, v FROM s WHERE y = DATE '1998-01-01' AND v >= 40 AND l_partkey NOT IN (SELECT l_partkey FROM s WHERE y = DATE '1997-01-01' AND v >= 40)""")
def newly_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts beyond the limit in one year's snapshot that were not in the year's before."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(F.max(F.col("l_suppkey") % 50).alias("v")).where("v >= 40")
    return s.where("y = 1998").join(s.where("y = 1997").select("l_partkey"), "l_partkey", "left_anti").select("l_partkey", "v")


@query(f"WITH {V_SQL}, w AS (SELECT user_id, client, max(ts) AS t, row_number() OVER (PARTITION BY client ORDER BY max(ts) DESC, user_id) AS k FROM v GROUP BY 1, 2) SELECT user_id, client FROM w WHERE k <= 8")
def slot_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users a cache of eight slots a client keeps: those seen last."""
    u = events(spark, sf_dir).groupBy("user_id", "client").agg(F.max("ts").alias("t"))
    return top_per_key(u, ["client"], [F.desc("t"), "user_id"], 8).select("user_id", "client")


@query("""SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of every customer."""
    return latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])
