"""Problem 7: filling containers of one capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tokens import byte_tokens
from graphloom.sources.tables import table

CAPACITY = 4096
GROUP_ROWS = 20_000
PLACED = "doc_id bigint, piece int, n_pieces int, size bigint, grp bigint, bin int, at bigint"


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset in the bin) of every size, in the order given, each into the first bin with room.

    A tournament tree over the bins holds the greatest room below each node; the leftmost leaf with enough
    room is found from the root. The tree doubles when the bins outgrow it.
    """
    width = 1
    tree = [0, capacity]  # tree[width + b] is the room of bin b; unopened bins have all of it
    bins, offsets = [], []
    for size in sizes:
        if tree[1] < size:  # every opened and unopened leaf is too full: double the tree
            leaves = tree[width:] + [capacity] * width
            width *= 2
            tree = [0] * width + leaves
            for i in range(width - 1, 0, -1):
                a, b = tree[2 * i], tree[2 * i + 1]
                tree[i] = a if a > b else b
        i = 1
        while i < width:
            i *= 2
            if tree[i] < size:
                i += 1
        bins.append(i - width)
        room = tree[i]
        offsets.append(capacity - room)
        tree[i] = room = room - size
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a > b else b
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, seed: int = 1) -> DataFrame:
    """One row per piece: its container (grp, bin) and its place ``at`` in it.

    ``items`` has doc_id and size. First-fit decreasing, run on its own in randomised groups of about
    ``group_rows`` items, so that no task holds more than a group and a source with a third of all
    rows falls evenly over the groups. An item stays whole unless it is larger than the capacity; then it fills containers of its own
    and its last piece is packed with the rest. Sizes of 0 are placed too and take no room; null sizes count as 0,
    negative ones are an error. Ties in size go by doc_id, repeated rows are items of their own. An empty
    input gives no row.
    """
    items = items.select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    groups = max(1, -(-items.count() // group_rows))
    items = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["size"] < 0).any():
            raise ValueError("an item has a negative size")
        n = np.maximum(1, -(-pdf["size"].to_numpy() // capacity)).astype(int)
        rows = pdf.loc[pdf.index.repeat(n)].reset_index(drop=True)
        piece = np.concatenate([np.arange(k) for k in n]) if len(n) else np.array([], int)
        rows["n_pieces"] = np.repeat(n, n)
        rows["piece"] = piece
        last = rows["piece"] == rows["n_pieces"] - 1
        rows["size"] = np.where(last, rows["size"] - (rows["n_pieces"] - 1) * capacity, capacity)
        rows = rows.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        rows["bin"], rows["at"] = first_fit(rows["size"].tolist(), capacity)
        rows["grp"] = key[0]
        return rows[["doc_id", "piece", "n_pieces", "size", "grp", "bin", "at"]]

    return items.groupBy("grp").applyInPandas(fill, PLACED)


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", byte_tokens(F.col("text")).alias("size"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are larger than one container, as the packing had to split them."""
    return pack(sized(spark, sf_dir)).where("n_pieces > 1").select("doc_id").distinct()


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: containers, pieces, tokens, and the share of room left over, per group."""
    placed = pack(sized(spark, sf_dir)).groupBy("grp", "bin").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
    return placed.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n_pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("left_over"),
    )


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text, or piece of one, lies where in which container."""
    return pack(sized(spark, sf_dir))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts and tokens that were placed, whether no container is over its capacity and no two pieces overlap, and whether at
    most a hundredth of the room is left over (or one container a group)."""
    p = pack(sized(spark, sf_dir))
    per = p.groupBy("grp", "bin").agg(F.sum("size").alias("used"), F.max(F.col("at") + F.col("size")).alias("end"), F.count_if(F.col("piece") == 0).alias("texts"))
    n, used = F.count(F.lit(1)), F.sum("used")
    return per.agg(
        F.sum("texts").alias("n_texts"), used.alias("tokens"), (F.max("used") <= CAPACITY).alias("within_capacity"), (F.bool_and(F.col("end") == F.col("used"))).alias("without_gaps"),
        ((n - F.countDistinct("grp")) * CAPACITY * 0.99 <= used).alias("well_filled"),
    )


QUERIES = {"p7_found": p7_found, "p7_bins": p7_bins, "p7_places": p7_places, "p7_totals": p7_totals}
_SIZE = "CASE WHEN text IS NULL OR regexp_matches(text, '^[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]*$') THEN 0 ELSE octet_length(encode(text)) + 1 END"
ORACLE = {
    "p7_found": f"SELECT DISTINCT doc_id FROM documents WHERE {_SIZE} > {CAPACITY}",
    "p7_totals": f"SELECT count(*) AS n_texts, CAST(sum({_SIZE}) AS BIGINT) AS tokens, true AS within_capacity, true AS without_gaps, true AS well_filled FROM documents",
}
