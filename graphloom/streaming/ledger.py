"""The event ledger as a stream: the same aggregates as in batch, with watermarks, sessions and kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEDGER = "ts timestamp, tool string, client string, source string, outcome string, tokens bigint, baseline bigint, ms double, model string"


def tail(spark: SparkSession, folder: str, schema: str = LEDGER, files_per_batch: int = 1000) -> DataFrame:
    """New lines of NDJSON files as they come; offsets live in the checkpoint, broken lines give null columns."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("mode", "PERMISSIVE").json(folder)


def tail_parquet(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """New parquet files of one name pattern in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def running_stats(events: DataFrame) -> DataFrame:
    """Counters by tool over everything seen: calls, complete, partial, miss, the last call."""
    o = F.col("outcome")
    return events.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(o == "complete").alias("complete"), F.count_if(o == "partial").alias("partial"), F.count_if(o == "miss").alias("miss"), F.max("ts").alias("last_at")
    )


def windowed(events: DataFrame, length: str = "7 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls and tokens of a sliding window by tool; events later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


def settled(events: DataFrame, key: str, quiet: str = "600 milliseconds", late: str = "1 minute") -> DataFrame:
    """Bursts of a key that have been quiet: a session window closes once nothing came for ``quiet``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), key).agg(F.count(F.lit(1)).alias("n"))


def kept(events: DataFrame, key: str, value: str, quiet_s: int) -> DataFrame:
    """(key, ts, value): events that change the last kept value of their key or come ``quiet_s`` after it.

    The state is one row a key. Events of a batch are taken in the order of their time; those with a null time are dropped.
    """
    kt, vt = events.schema[key].dataType.simpleString(), events.schema[value].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, some = state.get if state.exists else (None, None, False)
        out = []
        for row in pd.concat(list(frames)).dropna(subset=["ts"]).sort_values(["ts", value], kind="stable").itertuples(index=False):
            if not some or row.v != last or row.us - at >= quiet_s * 1_000_000:
                at, last, some = int(row.us), row.v, True
                out.append((k[0], row.us, row.v))
        if some:
            state.update((at, last, True))
        yield pd.DataFrame(out, columns=["key", "us", "v"])

    e = events.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col(value).alias("v"), F.col(value)) if value != "v" else events.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us"), "v")
    got = e.groupBy("key").applyInPandasWithState(step, f"key {kt}, us bigint, v {vt}", f"at bigint, last {vt}, some boolean", "append", GroupStateTimeout.NoTimeout)
    return got.select(F.col("key").alias(key), F.timestamp_micros("us").alias("ts"), F.col("v").alias(value))


def upload_batches(events: DataFrame, out: str, checkpoint: str):
    """Writes what came since the last batch, rolled up by model, client, tool and outcome; one folder a batch, so a retry overwrites its own."""

    def put(batch: DataFrame, nr: int) -> None:
        r = batch.groupBy("model", "client", "tool", "outcome").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
        r.write.mode("overwrite").parquet(f"{out}/batch={nr}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_new(events: DataFrame, table: str, checkpoint: str, key: list[str], spark: SparkSession):
    """Incremental build: of each batch only rows whose ``key`` (path and hash) the table lacks are written; others are reused."""

    def put(batch: DataFrame, nr: int) -> None:
        try:
            known = spark.read.parquet(table).select(*key)
        except Exception as e:  # the table does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = batch.select(*key).limit(0)
        batch.dropDuplicates(key).join(known, key, "left_anti").write.mode("append").parquet(table)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(result: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over what is there and leaves its latest full result as parquet under ``out``."""

    def put(batch: DataFrame, nr: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = result.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
