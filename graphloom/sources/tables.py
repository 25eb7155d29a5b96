"""Readers for the parquet tables and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read: ``spark.checkpoint.dir``.

    Only a local session (tests, one machine) that does not name one gets a temporary folder;
    a session on a cluster without the setting is an error, as a machine-local folder would lose rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    known = getattr(spark.sparkContext, "_graphloom_shared", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext._graphloom_shared = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return spark.sparkContext._graphloom_shared


class Scratch:
    """Written tables of one run of an operator, in the shared folder; results are lazy and read them, so ``clear`` is the caller's.

    ``keep`` writes a frame as parquet and reads it back, so that later steps neither recompute nor
    depend on an executor that may be lost. ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def clear(self) -> None:
        """Removes all tables of this run; results that still read them are gone with them."""
        self.drop("")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
