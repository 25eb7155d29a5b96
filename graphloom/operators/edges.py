"""Cleaned views of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import clean, clean_or_null, pack


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row for each (kind, src, dst), all cleaned; rows with a null or blank ``dst`` are left out.

    Ids are packed to bytes. Rows delivered many times fold together before the shuffle. A null
    ``kind`` or ``src`` is a value of its own.
    """
    e = edges.select(clean("kind").alias("kind"), pack(clean("src")).alias("src"), clean_or_null("dst").alias("dst"))
    e = e.where(F.col("dst").isNotNull()).withColumn("dst", pack("dst"))
    return e.dropDuplicates(["kind", "src", "dst"])
