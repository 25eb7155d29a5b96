"""Aggregates with a rule of their own: nearest rank, weighted means over what is known, votes, fusion, capped lists.

All combine map-side; exact percentiles hold one number a row of their group and so are for groups of bounded columns or
counts, the rank-based variant for any size is ``nearest_rank_by_count``. Nulls are left out of means and percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numbers import half_up, ratio


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(value x weight) / sum(weight) over rows where both are known; null where the weights add up to 0."""
    known = value.isNotNull() & weight.isNotNull()
    return ratio(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def nearest_rank_by_count(df: DataFrame, key: Sequence[str], value: str, share: float, out: str) -> DataFrame:
    """(key, out): the nearest-rank percentile, sorted[ceil(share x n) - 1], from counts of distinct values.

    Equal values fold before the shuffle, so a hot key costs as many rows as it has distinct values, not as it has rows.
    """
    from pyspark.sql import Window

    per = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = per.groupBy(*key).agg(F.sum("_n").alias("_total"))
    run = per.withColumn("_till", F.sum("_n").over(w)).join(total, list(key))
    need = F.greatest(F.ceil(F.col("_total") * F.lit(share)), F.lit(1))
    return run.where(F.col("_till") >= need).groupBy(*key).agg(F.min(value).alias(out))


def renormalised(parts: Sequence[tuple[Column, float]]) -> Column:
    """The weighted mean of the known parts, weights renormalised over those; null where none is known."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    value = sum((F.coalesce(c * F.lit(w), F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return ratio(value, total)


def argmax(df: DataFrame, key: Sequence[str], value: str, score: str, floor: float | None = None) -> DataFrame:
    """(key, value, score) of the greatest score per key, ties to the smallest value; scores below ``floor`` don't count."""
    d = df.where(F.col(score) >= floor) if floor is not None else df.where(F.col(score).isNotNull())
    best = d.groupBy(*key).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*key, F.col("_b.v").alias(value), (-F.col("_b.s")).alias(score))


def majority(df: DataFrame, key: Sequence[str], value: str, share: float, least: int) -> DataFrame:
    """(key, value, n, total): the commonest value of each key (ties to the smallest) where it has ``share`` of the rows and ``least`` or more."""
    per = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("_b"), F.sum("n").alias("total"))
    top = top.select(*key, F.col("_b.v").alias(value), (-F.col("_b.m")).alias("n"), "total")
    return top.where((F.col("n") >= least) & (F.col("n") >= F.col("total") * share))


def success_rate(ok: Column) -> Column:
    return half_up(100.0 * F.count_if(ok) / F.count(F.lit(1)), 2)


def same_sets(df: DataFrame, key: Sequence[str], member: str) -> DataFrame:
    """(key, first): keys whose sets of members are equal share the smallest of them; order and repetition do not matter.

    A set is compared by its size and two sums of its members' hashes, 64 bits each, so no set is gathered in one row.
    """
    d = df.where(F.col(member).isNotNull()).select(*key, member).distinct()
    sign = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64(member).cast("decimal(20,0)")).alias("_a"), F.sum(F.xxhash64(F.lit(7), member).cast("decimal(20,0)")).alias("_b")
    )
    first = sign.groupBy("_n", "_a", "_b").agg(F.min(F.struct(*key)).alias("_f"))
    return sign.join(first, ["_n", "_a", "_b"]).select(*key, *[F.col(f"_f.{k}").alias(f"first_{k}") for k in key])
