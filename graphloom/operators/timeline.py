"""Ordered changes: timelines, crossings, exposure windows, sessions, budgets, kept rows.

Order-dependent steps go through the chunked operators of ``skew``, so that one key may hold a
third of all rows. Rows with a null time are left out of ordered results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import running_sum, with_previous
from graphloom.sources.tables import Scratch


def changes(df: DataFrame, key: Sequence[str], order: Sequence, value: str, scratch: Scratch, name: str = "changes") -> DataFrame:
    """The rows whose ``value`` differs from the row before within the key, the first included, with ``prev_<value>``."""
    p = with_previous(df, key, order, [value], scratch, name)
    return p.where((F.col("_rn") == 0) | ~F.col(value).eqNullSafe(F.col(f"prev_{value}")))


def crossings(df: DataFrame, key: Sequence[str], order: Sequence, flag: str, scratch: Scratch, name: str = "crossings") -> DataFrame:
    """The rows where ``flag`` flips, the state before the first being false: ``entered`` true or false."""
    p = with_previous(df, key, order, [flag], scratch, name)
    return p.where(F.col(flag) != F.coalesce(F.col(f"prev_{flag}"), F.lit(False))).withColumn("entered", F.col(flag))


def exposures(df: DataFrame, key: Sequence[str], order: Sequence, at: str, flag: str, scratch: Scratch) -> DataFrame:
    """(key, started, ended): the runs of rows whose ``flag`` is true, from their first row to the first row behind them (null while open)."""
    flips = scratch.keep(crossings(df, key, order, flag, scratch, "flips").withColumn("_one", F.col("entered").cast("int")).select(*df.columns, "entered", "_one"), "flipped")
    # the run of a start is the starts before it plus itself; an end belongs to the last start before it
    runs = running_sum(flips, key, order, "_one", scratch, "runs").withColumn("_run", F.col("_before") + F.col("_one"))
    return runs.groupBy(*key, "_run").agg(F.min(F.when(F.col("entered"), F.col(at))).alias("started"), F.min(F.when(~F.col("entered"), F.col(at))).alias("ended")).drop("_run")


def sessions(df: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, started, ended, n): rows of a key closer together than ``gap``; the same call works on a stream with a watermark."""
    return df.where(F.col(at).isNotNull()).groupBy(key, F.session_window(at, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("ended")).select(key, F.col("_w.start").alias("started"), "ended", "n")


def within_budget(df: DataFrame, key: Sequence[str], order: Sequence, cost: str, budget: float, scratch: Scratch) -> DataFrame:
    """The leading rows of each key whose costs add up to no more than ``budget``, at least one row; adds ``used``. Null costs are 0."""
    r = running_sum(df, key, order, cost, scratch, "budget")
    used = F.col("_before") + F.coalesce(F.col(cost), F.lit(0))
    return r.withColumn("used", used).where((F.col("_rn") == 0) | (F.col("used") <= F.lit(budget))).drop("_before", "_rn")


def greedy(df: DataFrame, key: Sequence[str], order: Sequence[str], cost: str, take: Sequence[str], budget: Column) -> DataFrame:
    """The rows a greedy pass takes: in order, each that still fits the budget, others skipped. For keys that are one document's or order's rows.

    The fold is inherently in order; a key is folded as one array, so keys must be bounded by what one document holds.
    """
    items = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(cost).alias("_c"), *[F.col(c).alias(f"_t_{c}") for c in take]))).alias("_i"))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast(items.schema["_i"].dataType).alias("got"))
    fold = F.aggregate(
        "_i", start,
        lambda a, x: F.when(a["used"] + x["_c"] <= budget, F.struct((a["used"] + x["_c"]).alias("used"), F.concat(a["got"], F.array(x)).alias("got"))).otherwise(a),
    )
    got = items.select(*key, F.explode(fold["got"]).alias("_g"))
    return got.select(*key, *[F.col(f"_g._t_{c}").alias(c) for c in take])


def kept(df: DataFrame, key: Sequence[str], order: Sequence, at: str, value: str, quiet_s: int, scratch: Scratch) -> DataFrame:
    """(key, at, value): rows that change ``value`` against the last kept row, or come ``quiet_s`` seconds or more after it.

    Dropped rows equal the last kept one, so a change against it is a change against the row before: runs of equal values are
    independent, and only within a run is the chain of kept times folded.
    """
    p = with_previous(df.where(F.col(at).isNotNull()), key, order, [value], scratch, "kept")
    new = ((F.col("_rn") == 0) | ~F.col(value).eqNullSafe(F.col(f"prev_{value}"))).cast("int")
    marked = scratch.keep(p.withColumn("_new", new).select(*df.columns, "_new"), "marked")
    runs = running_sum(marked, key, order, "_new", scratch, "kept-runs").withColumn("_run", F.col("_before") + F.col("_new"))
    per = runs.groupBy(*key, "_run", value).agg(F.array_sort(F.collect_list(F.unix_micros(at))).alias("_ts"))
    none = F.array().cast("array<bigint>")
    chain = F.aggregate("_ts", none, lambda a, t: F.when((F.size(a) == 0) | (t - F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) >= F.lit(quiet_s * 1_000_000)), F.concat(a, F.array(t))).otherwise(a))
    return per.select(*key, F.explode(chain).alias("_t"), value).select(*key, F.timestamp_micros("_t").alias(at), value)


def until_first(df: DataFrame, key: Sequence[str], at: str, miss: Column) -> DataFrame:
    """The rows of each key before its first miss by ``at``; all rows where there is none. A grouped minimum, no window."""
    first = df.where(miss).groupBy(*key).agg(F.min(at).alias("_miss"))
    return df.join(first, list(key), "left").where(F.col("_miss").isNull() | (F.col(at) < F.col("_miss"))).drop("_miss")
