"""Problem 1: source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.files import task_files
from graphloom.llm.syntax import LANGUAGES, errors

PARSED = "task_id bigint, repository_id string, lang string, n_errors int, first_line int, first_cause string, lines array<int>, causes array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [errors(g, t) for g, t in zip(b["lang"].to_pylist(), b["content"].to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                b["task_id"], b["repository_id"], b["lang"],
                pa.array([len(e) for e in found], pa.int32()),
                pa.array([e[0][0] if e else None for e in found], pa.int32()),
                pa.array([e[0][1] if e else None for e in found], pa.string()),
                pa.array([[x[0] for x in e] for e in found], pa.list_(pa.int32())),
                pa.array([[x[1] for x in e] for e in found], pa.list_(pa.string())),
            ],
            names=["task_id", "repository_id", "lang", "n_errors", "first_line", "first_cause", "lines", "causes"],
        )


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file with all its syntax errors and the first cause.

    ``files`` has task_id, repository_id, lang, content; other columns are ignored. Files of another
    language and files with null content are left out; an empty file is valid. A very long file is
    one row of one task, read whole. Repeated rows give repeated rows.
    """
    f = files.select("task_id", "repository_id", "lang", "content")
    return f.where(F.col("content").isNotNull() & F.col("lang").isin(*LANGUAGES)).mapInArrow(_parse, PARSED)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not valid in their language."""
    return parse_files(task_files(spark, sf_dir)).where("n_errors > 0").select("task_id")


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every invalid file, in order."""
    bad = parse_files(task_files(spark, sf_dir)).where("n_errors > 0")
    return bad.select("task_id", "lang", F.posexplode(F.arrays_zip("lines", "causes")).alias("nr", "e")).select(
        "task_id", "lang", "nr", F.col("e.lines").alias("line"), F.col("e.causes").alias("cause")
    )


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and language: files, invalid files, their share and the share accepted."""
    per = parse_files(task_files(spark, sf_dir)).groupBy("repository_id", "lang").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("n_errors") > 0).alias("n_invalid")
    )
    share = F.round(F.col("n_invalid") / F.col("n_files"), 6)
    return per.withColumn("invalid_share", share).withColumn("accepted_share", F.round(1 - F.col("n_invalid") / F.col("n_files"), 6))


QUERIES = {"p1_found": p1_found, "p1_errors": p1_errors, "p1_rates": p1_rates}
ORACLE: dict[str, str] = {}
