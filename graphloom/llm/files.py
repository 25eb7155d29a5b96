"""Views of the source files that several problems share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table

# File extensions and the languages they mean.
EXTENSIONS = {"ts": "ts", "js": "js", "py": "py", "go": "go", "java": "java", "rs": "rust", "rb": "rb"}


def language(path: Column) -> Column:
    """The language that a path's extension means, or null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\s*$", 1))
    out = F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        out = F.when(ext == k, F.lit(v)).otherwise(out)
    return out


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per task: task_id, repository_id, abs, lang. Repeated and re-queued rows agree and fold; a null task_id is dropped."""
    t = table(spark, sf_dir, "parse_tasks").where("task_id is not null and abs is not null")
    t = t.groupBy("task_id").agg(F.min("abs").alias("abs"), F.min("repository_id").alias("repository_id"))
    return t.withColumn("lang", language(F.col("abs")))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(abs, content): the read with the latest ``read_at``; a tie goes to the greatest content.

    A file whose latest read failed has null content, even where an older read succeeded.
    """
    s = table(spark, sf_dir, "source_files").where("abs is not null")
    last = s.groupBy("abs").agg(F.max(F.struct("read_at", "content")).alias("last"))
    return last.select("abs", F.col("last.content").alias("content"))


def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, repository_id, abs, lang, content of every task whose file has current content."""
    return tasks(spark, sf_dir).join(current(spark, sf_dir).where("content is not null"), "abs")


def all_task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``task_files``, of every task; content is null where the latest read failed or there is none."""
    return tasks(spark, sf_dir).join(current(spark, sf_dir), "abs", "left")
