"""Problem 6: credentials in source files and in the facts kept of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.files import task_files, tasks
from graphloom.llm.secrets import anchor, blank, candidates, scanner
from graphloom.sources.tables import Scratch, table

OWNER_SHARE = 0.25  # a literal that more than this share of the repositories hold stands in for a credential
OWNERS = 4  # and more repositories than this
BLOCK = 20_000  # literals without a run to look them up by that one pass over the texts searches for
BROADCAST_BYTES = 32 << 20  # greatest index of literals that is sent to every executor

TEXTS = "text_id bigint, task_id bigint, repository_id string, place string, field string, line int, text string"
HITS = "text_id bigint, task_id bigint, repository_id string, place string, line int, start_at int, end_at int, value string, kind string, anchor string"
SPANS = "text_id bigint, task_id bigint, place string, line int, start_at int, end_at int"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that may hold credentials: the current content of the files, and the signatures, docs and guards of all their cache entries."""
    files = task_files(spark, sf_dir).select(
        "task_id", "repository_id", F.lit("content").alias("place"), F.lit("content").alias("field"), F.lit(None).cast("int").alias("line"), F.col("content").alias("text")
    )
    kept = table(spark, sf_dir, "cache_entries").where("repository_id is not null and rel is not null and parse is not null").select(
        F.concat(F.lit("/srv/checkouts/"), "repository_id", F.lit("/"), "rel").alias("abs"),
        F.explode(F.concat(
            F.transform(F.coalesce("parse.defs", F.array()), lambda d: F.struct(F.lit("signature").alias("field"), d.start_line.alias("line"), d.signature.alias("text"))),
            F.transform(F.coalesce("parse.defs", F.array()), lambda d: F.struct(F.lit("doc").alias("field"), d.start_line.alias("line"), d.doc.alias("text"))),
            F.transform(F.coalesce("parse.guards", F.array()), lambda g: F.struct(F.lit("guard").alias("field"), g.line.alias("line"), g.expr.alias("text"))),
        )).alias("t"),
    ).where("length(t.text) >= 6")
    kept = kept.select("abs", "t.field", "t.line", "t.text").distinct().join(tasks(spark, sf_dir), "abs")
    kept = kept.select("task_id", "repository_id", F.lit("parse").alias("place"), "field", "line", "text")
    return files.unionByName(kept).select(F.monotonically_increasing_id().alias("text_id"), "*")


def _line(place: str, line: int | None, text: str, start: int) -> int | None:
    return text.count("\n", 0, start) + 1 if place == "content" else line


_short = lru_cache(50_000)(candidates)  # signatures, docs and guards repeat a lot


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("text_id", pa.int64()), ("task_id", pa.int64()), ("repository_id", pa.string()), ("place", pa.string()), ("line", pa.int32()),
        ("start_at", pa.int32()), ("end_at", pa.int32()), ("value", pa.string()), ("kind", pa.string()), ("anchor", pa.string()),
    ])
    for b in batches:
        rows = []
        for i, task, repo, place, line, text in zip(*(b[c].to_pylist() for c in ("text_id", "task_id", "repository_id", "place", "line", "text"))):
            for h in _short(text) if len(text) < 300 else candidates(text):
                rows.append((i, task, repo, place, _line(place, line, text, h.start), h.start, h.end, h.value, h.kind, anchor(h.value)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _rescan(always: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("text_id", pa.int64()), ("task_id", pa.int64()), ("place", pa.string()), ("line", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32())])
        for b in batches:
            rows = []
            # one automaton a batch: what a text holds of the literals of others has its run in the text too, so is its own
            scan = scanner({*always, *(v for values in b["values"].to_pylist() for v in values or ())})
            for i, task, place, line, text in zip(*(b[c].to_pylist() for c in ("text_id", "task_id", "place", "line", "text"))):
                for s, e in scan(text):
                    rows.append((i, task, place, _line(place, line, text, s), s, e))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return run


def spans(t: DataFrame, scratch: Scratch) -> DataFrame:
    """Every place of a credential in the texts: text_id, task_id, place, line, start_at, end_at; one may lie in another.

    ``t`` has the columns of ``texts`` and is read several times. Candidates come from each text alone. The corpus then
    counts for every literal the repositories that hold it: what very many hold is a stand-in or a documented sample,
    whatever its form. All literals that are left are searched for in every text: a text is looked up by the longest run
    of letters and digits of a literal, then scanned for exactly those literals. The index is joined, not broadcast.
    """
    hits = scratch.keep(t.mapInArrow(_candidates, HITS), "hits")
    n = t.agg(F.countDistinct("repository_id")).first()[0]
    index = hits.groupBy("value").agg(F.countDistinct("repository_id").alias("owners"), F.min("anchor").alias("anchor"), F.min("kind").alias("kind"))
    index = scratch.keep(index.where(F.col("owners") <= max(OWNERS, OWNER_SHARE * n)), "index")
    own = hits.join(index.select("value"), "value", "left_semi").select("text_id", "task_id", "place", "line", "start_at", "end_at")
    # private keys are written over lines and found by their form everywhere
    plain = index.where("kind <> 'private key'")
    words = t.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{4,}"), F.lit(0)))).alias("anchor"))
    size = plain.agg(F.count_if(F.col("anchor").isNull()).alias("bare"), F.coalesce(F.sum(F.octet_length("value") + 64), F.lit(0)).alias("bytes")).first()
    found = plain.where("anchor is not null").select("anchor", "value")
    # a small index saves the words of all texts a shuffle; beyond the bound both sides are shuffled by the run
    found = F.broadcast(found) if size["bytes"] <= BROADCAST_BYTES else found
    need = words.join(found, "anchor").groupBy("text_id").agg(F.collect_set("value").alias("values"))
    # literals without such a run are few: at most three letters or digits between marks; they go over all texts in blocks of a fixed size
    bare = plain.where("anchor is null").select("value")
    blocks = max(1, -(-size["bare"] // BLOCK))
    scan = t.select("text_id", "task_id", "place", "line", "text")
    out = own
    for k in range(blocks):
        always = [r["value"] for r in bare.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == k).collect()]
        some = scan.join(need, "text_id", "left" if always else "inner") if k == 0 else scan.withColumn("values", F.array().cast("array<string>"))
        out = out.unionByName(some.mapInArrow(_rescan(always), SPANS))
    return out


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where credentials begin: one row per task, place and line."""
    scratch = Scratch(spark, "secrets")
    return spans(scratch.keep(texts(spark, sf_dir), "texts"), scratch).select("task_id", "place", "line").distinct()


def _blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [blank(t, [(x["start_at"], x["end_at"]) for x in s]) for t, s in zip(b["text"].to_pylist(), b["spans"].to_pylist())]
        cols = ["task_id", "place", "field", "line"]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in cols), pa.array(out, pa.string())], names=[*cols, "text"])


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that holds credentials, with each of them blanked out and all else as it was."""
    scratch = Scratch(spark, "redacted")
    t = scratch.keep(texts(spark, sf_dir), "texts")
    s = spans(t, scratch).groupBy("text_id").agg(F.collect_set(F.struct("start_at", "end_at")).alias("spans"))
    return t.join(s, "text_id").select("task_id", "place", "field", "line", "text", "spans").mapInArrow(
        _blank, "task_id bigint, place string, field string, line int, text string"
    )


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
ORACLE: dict[str, str] = {}
