"""Per-key results when a few keys hold most of the rows.

Exact offset chunking: the rows of every key are counted per input partition, the counts become
offsets by a prefix sum over partitions, each row gets its exact number within its key, equal-sized
chunks of a key are processed apart from each other, and the states at the chunk borders are merged
in order. No task ever holds more than one chunk of a key, however hot the key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import Scratch

CHUNK_ROWS = 1 << 18
_POS = (1 << 33) - 1


def number_rows(
    df: DataFrame, key: Sequence[str], order: Sequence[Column | str], scratch: Scratch, name: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Every row with ``_rn`` (its 0-based number within ``key``) and ``_chunk`` (``_rn`` // chunk_rows).

    With ``order``, numbers follow that order (make it total for a repeatable result); without, any.
    The frame is written once, so partitions keep their number when an executor is lost.
    Null keys form one key of their own. Extra columns pass through; names starting with ``_gl``
    and ``_rn``, ``_chunk`` are reserved. An empty frame gives an empty frame.
    """
    key = list(key)
    if order:
        df = df.repartitionByRange(*key, *order)
    df = df.sortWithinPartitions(*key, *order).withColumn("_glid", F.monotonically_increasing_id())
    df = scratch.keep(df, name)
    spot = (F.shiftright("_glid", 33).alias("_glp"), F.col("_glid").bitwiseAND(F.lit(_POS)).alias("_glpos"))
    df = df.select("*", *spot)
    per = df.groupBy("_glp", *key).agg(F.count(F.lit(1)).alias("_gln"), F.min("_glpos").alias("_glmin"))
    # at most one row for each input partition and key, and only keys seen in two partitions need a sum
    w = Window.partitionBy(*key).orderBy("_glp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("_gloff", F.sum("_gln").over(w) - F.col("_gln") - F.col("_glmin"))
    per = per.select(F.col("_glp").alias("_glp2"), *[F.col(k).alias(f"_glk_{k}") for k in key], "_gloff")
    on = F.col("_glp") == F.col("_glp2")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_glk_{k}"))
    df = df.join(per, on).withColumn("_rn", F.col("_gloff") + F.col("_glpos"))
    df = df.withColumn("_chunk", F.floor(F.col("_rn") / F.lit(chunk_rows)).cast("long"))
    return df.drop("_glid", "_glp", "_glpos", "_glp2", "_gloff", *[f"_glk_{k}" for k in key])


def running_sum(
    df: DataFrame, key: Sequence[str], order: Sequence[Column | str], value: str, scratch: Scratch, name: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Every row with ``_before``: the sum of ``value`` over the rows of its key that come earlier.

    A window over a hot key would hold it in one task; here each chunk sums its own rows and takes
    the sum of the chunks before it, of which there is one row a chunk. Null values count as 0.
    """
    key = list(key)
    num = number_rows(df, key, order, scratch, name, chunk_rows)
    v = F.coalesce(F.col(value), F.lit(0))
    inner = Window.partitionBy(*key, "_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    num = num.withColumn("_gls", F.sum(v).over(inner) - v)
    chunks = num.groupBy(*key, "_chunk").agg(F.sum(v).alias("_glc"))
    outer = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = chunks.withColumn("_glb", F.sum("_glc").over(outer) - F.col("_glc")).drop("_glc")
    chunks = chunks.select(*[F.col(k).alias(f"_glk_{k}") for k in key], F.col("_chunk").alias("_glchunk"), "_glb")
    on = F.col("_chunk") == F.col("_glchunk")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_glk_{k}"))
    num = num.join(chunks, on).withColumn("_before", F.col("_gls") + F.col("_glb"))
    return num.drop("_gls", "_glb", "_glchunk", "_chunk", *[f"_glk_{k}" for k in key])


def key_profile(
    df: DataFrame, key: str, at: str, scratch: Scratch, name: str, chunk_rows: int = CHUNK_ROWS,
    order: Sequence[str] = (),
) -> DataFrame:
    """Per key, over its rows in the order of ``at``: ``n_rows``, ``first_at``, ``last_at`` and
    ``longest_gap_s``, the longest time in seconds between neighbouring rows (null for one row).

    The gap is order-dependent: each chunk yields its inner gap and its border times, and the borders
    of neighbouring chunks are merged in order. Rows with a null ``at`` count in ``n_rows`` only.
    """
    num = number_rows(df, [key], [F.col(at), *order], scratch, name, chunk_rows)
    w = Window.partitionBy(key, "_chunk").orderBy("_rn")
    gap = F.unix_micros(F.col(at)) - F.unix_micros(F.lag(at).over(w))
    states = num.withColumn("_gap", gap).groupBy(key, "_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.max("_gap").alias("gap")
    )
    # one row a chunk is left; the border gap is this chunk's first time less the one before's last
    border = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("edge", F.unix_micros("lo") - F.unix_micros(F.max("hi").over(border)))
    return states.groupBy(key).agg(
        F.sum("n").alias("n_rows"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"),
        (F.max(F.greatest("gap", "edge")) / F.lit(1e6)).alias("longest_gap_s"),
    )


def heavy_keys(
    df: DataFrame, key: str, one_in: int, scratch: Scratch, name: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Keys that hold at least 1 / ``one_in`` of all rows: (key, n_rows, n_total).

    Each chunk of a key is counted on its own and the counts are merged. Nulls in ``key`` must be gone.
    """
    num = number_rows(df, [key], [], scratch, name, chunk_rows)
    states = num.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("n"))
    keys = states.groupBy(key).agg(F.sum("n").alias("n_rows"))
    n = scratch.spark.read.parquet(scratch.path(name)).count()
    return keys.withColumn("n_total", F.lit(n).cast("long")).where(F.col("n_rows") * F.lit(one_in) >= F.col("n_total"))


def with_previous(
    df: DataFrame, key: Sequence[str], order: Sequence[Column | str], cols: Sequence[str], scratch: Scratch, name: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Every row with ``prev_<col>`` of the row before it within its key (null for the first) and ``_rn``.

    What ``lag`` gives, without a task that holds all rows of a hot key: rows look back within their chunk, and the first
    row of a chunk takes the last row of the chunk before, of which there is one. Make the order total for a repeatable result.
    """
    key = list(key)
    num = number_rows(df, key, order, scratch, name, chunk_rows)
    w = Window.partitionBy(*key, "_chunk").orderBy("_rn")
    num = num.select("*", *[F.lag(c).over(w).alias(f"_in_{c}") for c in cols], (F.row_number().over(w) == 1).alias("_first"))
    last = num.groupBy(*key, "_chunk").agg(F.max_by(F.struct(*cols), "_rn").alias("_last"))
    last = last.select(*[F.col(k).alias(f"_glk_{k}") for k in key], (F.col("_chunk") + 1).alias("_glchunk"), "_last")
    on = F.col("_first") & (F.col("_chunk") == F.col("_glchunk"))
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_glk_{k}"))
    out = num.join(last, on, "left")
    prev = [F.when(F.col("_first"), F.col(f"_last.{c}")).otherwise(F.col(f"_in_{c}")).alias(f"prev_{c}") for c in cols]
    return out.select(*df.columns, *prev, "_rn")
