"""Problem 8: mixing sources to target weights."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.p7_packing import _SIZE
from graphloom.llm.tokens import byte_tokens
from graphloom.operators.skew import running_sum
from graphloom.sources.tables import Scratch, table

BLOCK_TOKENS = 1 << 20


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """shares^exponent, normalised: 1 keeps the shares, 0 makes all sources with tokens equal. Sources without tokens get 0."""
    w = {s: v**exponent if v > 0 else 0.0 for s, v in shares.items()}
    total = sum(w.values())
    return {s: v / total for s, v in w.items()} if total else w


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def bisect(fits, steps: int = 80) -> float:
    """The greatest exponent in [0, 1] that fits; ``fits`` holds on an interval from 0, or nowhere (then 0)."""
    if fits(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def weights(sizes: dict[str, int], shares: dict[str, float], repeats: dict[str, int], budget: int) -> tuple[dict[str, float], dict[str, float]]:
    """(tokens to draw per source, exponent per source).

    A source's draw lies on the way from its own tokens n to its target tokens t = share x budget: n x (t / n)^e. Exponent 1
    gives the target, 0 one pass over the source. The exponent is bisected to the greatest that the repetition limit
    n x max_repeats allows, for each source by itself, so that a source that falls short takes nothing from those that don't.
    """
    tokens: dict[str, float] = {}
    exponents: dict[str, float] = {}
    for s, share in shares.items():
        n, goal, cap = sizes.get(s, 0), share * budget, sizes.get(s, 0) * repeats[s]

        def draw(e: float) -> float:
            return goal if e == 1.0 else n * (goal / n) ** e if n and goal > 0 else 0.0

        e = bisect(lambda x: draw(x) <= cap) if n and cap and goal > 0 else float(cap >= goal)
        # tokens are whole: what the bisection leaves below the limit is none
        exponents[s], tokens[s] = e, float(cap) if e < 1.0 and cap - draw(e) < 0.5 else min(draw(e), float(cap))
    return tokens, exponents


def temperature(sizes: dict[str, int], repeats: dict[str, int], budget: int, target_entropy: float) -> tuple[dict[str, float], float]:
    """(weights, exponent): source token shares to the greatest exponent at which they have the target entropy at least.

    Where the repetition limits forbid weights that even, the exponent goes up to the smallest one they allow: a source may
    get at most size x max_repeats of the budget.
    """
    total = sum(sizes.values())
    natural = {s: n / total if total else 0.0 for s, n in sizes.items()}
    by_entropy = bisect(lambda e: entropy(tempered(natural, e)) >= target_entropy)

    def allowed(e: float) -> bool:
        w = tempered(natural, e)
        return all(w[s] * budget <= sizes[s] * repeats[s] * (1 + 1e-12) for s in sizes if sizes[s])

    # 1 - e: the limits hold on an interval that ends at the natural shares
    by_limit = 1.0 - bisect(lambda d: allowed(1.0 - d))
    e = max(by_entropy, by_limit)
    return tempered(natural, e), e


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """The texts of a source's one block at the edge of its budget, in the order of their hashes, each that still fits."""
    block = block.sort_values(["h", "doc_id"], kind="stable")
    room = float(block["rest"].iloc[0]) - int(block["from"].iloc[0])
    take = []
    for size in block["size"]:
        fits = size <= room
        room -= size if fits else 0
        take.append(fits)
    return block[take]


class Mix:
    """The mix of documents (doc_id, source, size) for targets (source, target_share, max_repeats).

    Sources are compared trimmed and in lower case. Documents without a source, or of one without a target, count in the budget only.
    Equal texts count each. Null sizes are 0; a null share is 0, null repeats are 1; repeated target rows: the first by share and repeats.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 1):
        self.scratch = Scratch(docs.sparkSession, "mix")
        clean = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
        docs = docs.select("doc_id", clean.alias("source"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
        self.docs = self.scratch.keep(docs, "docs")
        self.targets = targets.groupBy(clean.alias("source")).agg(F.min(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("reps"))).alias("t")).where("source is not null")
        self.seed = seed
        # one row a target source: bounded by the target table, not by the documents
        rows = self.targets.select("source", "t.share", "t.reps").collect()
        per = self.docs.groupBy("source").agg(F.sum("size").alias("n"))
        known = {r["source"]: r["n"] for r in per.join(self.targets.select("source"), "source", "left_semi").collect()}
        self.total = self.docs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        self.sizes = {r["source"]: known.get(r["source"]) or 0 for r in rows}
        self.shares = {r["source"]: r["share"] for r in rows}
        self.repeats = {r["source"]: r["reps"] for r in rows}
        self.tokens, self.exponents = weights(self.sizes, self.shares, self.repeats, self.total)
        # what the bisection could not bring to its target
        self.short = {s for s, e in self.exponents.items() if e < 1.0}

    def draws(self) -> DataFrame:
        """(doc_id, source, pass, size) of every drawn text.

        Each pass over a source is a permutation of its own, by hash. Whole passes are taken whole; of the last
        pass, blocks of about BLOCK_TOKENS are taken in the permutation's order while they fit the
        budget, and of the one block that crosses it, texts in order, each that still fits. No task sorts a source.
        """
        spark = self.docs.sparkSession
        plan = [(s, int(t // self.sizes[s]), float(t - (t // self.sizes[s]) * self.sizes[s]), max(1, self.sizes[s] // BLOCK_TOKENS)) for s, t in self.tokens.items() if self.sizes[s]]
        plan_df = spark.createDataFrame(plan, "source string, full int, rest double, blocks long")
        d = self.docs.join(F.broadcast(plan_df), "source").where("size > 0")
        whole = d.where("full > 0").select("doc_id", "source", F.explode(F.expr("sequence(0, full - 1)")).alias("pass"), "size")
        h = F.xxhash64("doc_id", "full", F.lit(self.seed))
        last = d.where("rest > 0").withColumn("h", h).withColumn("block", F.pmod(F.shiftright("h", 8), F.col("blocks")))
        last = self.scratch.keep(last.select("doc_id", "source", F.col("full").alias("pass"), "size", "rest", "h", "block"), "last")
        per = last.groupBy("source", "block").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        # a source has as many blocks as it has mebitokens, so the sum runs over chunks of blocks, not over a source in one task
        per = running_sum(per, ["source"], ["block"], "n", self.scratch, "blocks")
        per = per.select("source", "block", F.col("_before").alias("from"), (F.col("_before") + F.col("n")).alias("till"))
        last = last.join(per, ["source", "block"])
        inside = last.where("till <= rest")
        edge = last.where("from < rest and till > rest")
        edge = edge.groupBy("source").applyInPandas(_fill, edge.schema)
        return whole.union(inside.union(edge).select("doc_id", "source", "pass", "size"))

    def report(self) -> DataFrame:
        """Per target source: its share, what it can give at most, what was drawn, and the share reached."""
        spark = self.docs.sparkSession
        drawn = self.draws().groupBy("source").agg(F.sum("size").alias("drawn"), (F.max("pass") + 1).alias("passes"))
        facts = [(s, self.shares[s], self.repeats[s], self.sizes[s], self.sizes[s] * self.repeats[s], s in self.short, self.exponents[s]) for s in self.shares]
        facts_df = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, size long, can_give long, falls_short boolean, exponent double")
        drawn = self.scratch.keep(drawn, "drawn")
        total = drawn.agg(F.coalesce(F.sum("drawn"), F.lit(0)).alias("n")).first()["n"]
        out = facts_df.join(drawn, "source", "left").fillna(0, ["drawn", "passes"])
        return out.withColumn("reached_share", F.round(F.col("drawn") / F.lit(max(total, 1)), 6)).withColumn("of_budget", F.round(F.col("drawn") / F.lit(max(self.total, 1)), 6))


def mix(spark: SparkSession, sf_dir: str) -> Mix:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", byte_tokens(F.col("text")).alias("size"))
    return Mix(docs, table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share, as the repetition limit holds them."""
    m = mix(spark, sf_dir)
    names = m.targets.where(F.col("source").isin(*m.short)) if m.short else m.targets.limit(0)
    raw = table(spark, sf_dir, "mix_targets")
    key = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
    return raw.join(F.broadcast(names.select("source").withColumnRenamed("source", "k")), key == F.col("k")).select("source").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: what was drawn over all passes, the passes, and its share of all that was drawn."""
    return mix(spark, sf_dir).report()


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn text with its pass."""
    return mix(spark, sf_dir).draws()


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source whether the draws keep what they promise: no text too often, no source above its target, and none that can
    reach it further below than the texts of one block's end are long."""
    m = mix(spark, sf_dir)
    per = m.draws().groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("times"))
    # a doc_id that stands in the table twice may be drawn twice a pass
    own = m.docs.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"))
    got = per.join(own, ["source", "doc_id", "size"]).groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("drawn"), F.max(F.ceil(F.col("times") / F.col("rows"))).alias("most"))
    got = m.docs.groupBy("source").agg(F.max("size").alias("longest")).join(got, "source", "left")
    facts = spark.createDataFrame([(s, m.repeats[s], m.shares[s] * m.total, s in m.short, float(m.sizes[s] * m.repeats[s])) for s in m.shares], "source string, reps int, goal double, short boolean, cap double")
    x = facts.join(got, "source", "left").fillna(0, ["drawn", "most", "longest"])
    near = F.col("drawn") + F.col("longest") >= F.least("goal", "cap")
    return x.select("source", (F.col("most") <= F.col("reps")).alias("repeats_kept"), (F.col("drawn") <= F.least("goal", "cap") + 0.5).alias("within_target"), near.alias("target_met"))


def p8_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix without targets: weights from the sources' own shares, as even as the targets are by entropy, within the limits."""
    m = mix(spark, sf_dir)
    goal = {s: v / sum(m.shares.values()) for s, v in m.shares.items()} if sum(m.shares.values()) else m.shares
    w, e = temperature(m.sizes, m.repeats, sum(m.sizes.values()), entropy(goal))
    total = max(1, sum(m.sizes.values()))
    return spark.createDataFrame([(s, m.sizes[s] / total, w[s], e) for s in m.shares], "source string, natural_share double, weight double, exponent double")


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares, "p8_draws": p8_draws, "p8_limits": p8_limits, "p8_temperature": p8_temperature}
ORACLE = {
    "p8_found": f"""
WITH d AS (SELECT lower(trim(source)) AS source, {_SIZE} AS size FROM documents),
s AS (SELECT source, sum(size) AS n FROM d GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source))
WHERE coalesce(s.n, 0) * m.max_repeats < m.target_share * (SELECT sum(size) FROM d)""",
    # the draws are random, what must hold of them is not
    "p8_limits": "SELECT DISTINCT lower(trim(source)) AS source, true AS repeats_kept, true AS within_target, true AS target_met FROM mix_targets",
}