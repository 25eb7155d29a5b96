"""Problem 9: sentence boundaries across languages and scripts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.sentences import evidence, looks_like_chat, sentences
from graphloom.sources.tables import Scratch, table

FOUND = "doc_id bigint, nr int, start_at int, end_at int"


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, each behind the letter of its kind, and the two counts of each; flat lists are cheaper to carry than structs."""
    for b in batches:
        texts = b["text"].to_pylist()
        chats = [looks_like_chat(t) for t in texts]
        own = [evidence(t, c) for t, c in zip(texts, chats)]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["text"], pa.array(chats, pa.bool_()), pa.array(map(list, own), pa.list_(pa.string())), *(pa.array(([c[i] for c in o.values()] for o in own), pa.list_(pa.int32())) for i in (0, 1))],
            names=["doc_id", "text", "chat", "word", "yes", "no"],
        )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids: list[int] = []
        nrs: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        for i, text, chat, word, yes, no, known in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "chat", "word", "yes", "no", "known"))):
            own = dict(zip(word, zip(yes, no)))
            for nr, (s, e) in enumerate(sentences(text, chat, frozenset(known or ()), own)):
                ids.append(i)
                nrs.append(nr)
                starts.append(s)
                ends.append(e)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(nrs, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            names=["doc_id", "nr", "start_at", "end_at"],
        )


def split_sentences(docs: DataFrame) -> DataFrame:
    """One row per sentence of every document: doc_id, nr (from 0), start_at, end_at in code points.

    Two passes. The first collects from every document what its unambiguous places say about words
    before full stops, words that start sentences and names; the sums over the corpus are joined back to the documents that
    hold the words. The second splits each document by its own evidence, then the corpus's. Documents
    whose text is null, empty or white space give no row. Repeated rows give repeated sentences; a null doc_id is
    kept as null. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    scratch = Scratch(docs.sparkSession, "sentences")
    seen = docs.mapInArrow(_evidence, "doc_id bigint, text string, chat boolean, word array<string>, yes array<int>, no array<int>")
    seen = scratch.keep(seen.withColumn("text_id", F.monotonically_increasing_id()), "evidence")
    ev = seen.select("text_id", F.inline(F.arrays_zip("word", "yes", "no"))).withColumn("kind", F.left("word", F.lit(1)))
    # summed map-side: one row a word and task is shuffled
    stats = ev.groupBy("word").agg(F.first("kind").alias("kind"), F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    word, kind, yes, no = (F.col(c) for c in ("word", "kind", "yes", "no"))
    said = (
        F.when(kind == "A", F.when((yes >= 3) & (yes * 2 > no * 3), word).when((no >= 3) & (no > yes * 2), F.concat(F.lit("N"), F.substring(word, 2, 1 << 30))))
        .when(kind == "T", F.when((yes >= 5) & (yes > no * 6), word))
        .when((yes >= 2) & (yes > no), word)
    )
    stats = scratch.keep(stats.select("word", said.alias("said")).where("said is not null"), "said")
    # a text that decides on a word by itself need not be told: most texts on most frequent words, so that none of those is a hot key
    ask = ev.where(~((kind == "S") & (yes > no)) & ~((kind == "P") & (yes > 0)) & ~((kind == "A") & (yes + no >= 3) & ((yes > 2 * no) | (no > 2 * yes))))
    known = ask.select("text_id", "word").join(stats, "word").groupBy("text_id").agg(F.collect_set("said").alias("known"))
    return seen.join(known, "text_id", "left").select("doc_id", "text", "chat", "word", "yes", "no", "known").mapInArrow(_split, FOUND)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences of all documents."""
    return split_sentences(table(spark, sf_dir, "documents")).select("doc_id", "start_at", "end_at")


QUERIES = {"p9_found": p9_found}
ORACLE: dict[str, str] = {}
