"""Problem 5: generated, minified or vendored source files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.files import all_task_files
from graphloom.llm.handmade import N_GRAMS, gram_ids, identifiers, model_of, name_diversity, notices, path_says, said, said_anywhere, shape, style
from graphloom.sources.tables import Scratch

DATA_SHARE = 0.6  # share of the characters on lines of literals only
DATA_CHARS = 200
DIVERSITY = 0.25  # distinct line shapes among the lines, of at least DIVERSE_LINES
DIVERSE_LINES = 8
NAME_DIVERSITY = 0.5  # distinct trigrams among those of the names; below, one template made them
MANGLED_BITS = 3.2  # per character, under the language model that fits best
SHORT_SHARE = 0.3  # share of names of at most two letters among the distinct names
LONG_CODE = 300  # characters of one line outside strings
STYLE_NAMES = 12  # names with a style that a file needs before its style is judged
STYLE_SHARE = 0.9

_SHAPE = ["n_chars", "n_lines", "data_share", "long_share", "longest_code", "diversity", "bundle", "name_diversity"]
# one row per file, and per task one row for each language with the trigram counts and styles of its unsuspected files
FEATURES = (
    "task_id bigint, repository_id string, lang string, path_says string, tool boolean, copied boolean, "
    + ", ".join(f"{c} double" for c in _SHAPE) + ", short_share double, camel bigint, snake bigint, grams binary, counts array<bigint>"
)
_NAMES = ["task_id", "repository_id", "lang", "path_says", "tool", "copied", *_SHAPE, "short_share", "camel", "snake", "grams", "counts"]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    styles: dict[str, list[int]] = {}
    for b in batches:
        cols: dict[str, list] = {c: [] for c in _NAMES[3:-1]}
        for path, lang, text in zip(b["abs"].to_pylist(), b["lang"].to_pylist(), b["content"].to_pylist()):
            text = text or ""
            if "\x00" in text:  # another encoding that was read as this one
                text = text.replace("\x00", "")
            t, c = said(notices(text, lang or ""))
            if not (t or c):
                t, c = said_anywhere(text)
            where = path_says(path)
            names = list(identifiers(text, lang or ""))
            ids = b"".join(map(gram_ids, names))
            st = list(map(style, names))
            camel, snake = st.count("camel"), st.count("snake")
            row = {"path_says": where, "tool": t, "copied": c, "short_share": sum(map(_is_short, names)) / len(names) if names else 0.0,
                   "camel": camel, "snake": snake, "grams": ids, "name_diversity": name_diversity(names)} | shape(text, lang or "")
            for k, v in row.items():
                cols[k].append(v)
            # a file that says itself that nobody wrote it here is no sample of the language
            if lang and not (where or t or c):
                if lang not in counts:
                    counts[lang], styles[lang] = np.zeros(N_GRAMS, np.int64), [0, 0]
                if ids:
                    counts[lang] += np.bincount(np.frombuffer(ids, np.uint16), minlength=N_GRAMS)
                styles[lang][0] += camel
                styles[lang][1] += snake
        yield pa.RecordBatch.from_arrays(
            [b["task_id"], b["repository_id"], b["lang"], *(pa.array(cols[c], _TYPES.get(c, pa.float64())) for c in _NAMES[3:-1]), pa.nulls(len(b), pa.list_(pa.int64()))],
            names=_NAMES,
        )
    if counts:
        n = len(counts)
        one = {"lang": pa.array(list(counts), pa.string()), "camel": pa.array([styles[x][0] for x in counts], pa.int64()),
               "snake": pa.array([styles[x][1] for x in counts], pa.int64()), "counts": pa.array(list(counts.values()), pa.list_(pa.int64()))}
        types = {"task_id": pa.int64(), "repository_id": pa.string(), **_TYPES}
        yield pa.RecordBatch.from_arrays([one.get(c, pa.nulls(n, types.get(c, pa.float64()))) for c in _NAMES], names=_NAMES)


_TYPES = {"path_says": pa.string(), "tool": pa.bool_(), "copied": pa.bool_(), "camel": pa.int64(), "snake": pa.int64(), "grams": pa.binary()}


@lru_cache(200_000)
def _is_short(name: str) -> bool:
    return len(name.strip("_$")) <= 2


def _judge(models: dict[str, np.ndarray]):
    langs = sorted(models)
    bits = np.stack([models[x] for x in langs]).astype(np.float64) if langs else np.zeros((0, N_GRAMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean, best = [], []
            for raw in b["grams"].to_pylist():
                if raw and langs:
                    n = np.bincount(np.frombuffer(raw, np.uint16), minlength=N_GRAMS)
                    seen = np.flatnonzero(n)
                    sums = bits[:, seen] @ n[seen]
                    k = int(sums.argmin())
                    mean.append(float(sums[k]) * 2 / len(raw))
                    best.append(langs[k])
                else:
                    mean.append(0.0)
                    best.append(None)
            keep = [c for c in b.schema.names if c != "grams"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(mean, pa.float64()), pa.array(best, pa.string())], names=[*keep, "bits", "reads_like"])

    return run


def classify(files: DataFrame) -> DataFrame:
    """One row per file with its features and ``reason``: null for hand-written files, else why not.

    ``files`` has task_id, repository_id, abs, lang, content; other columns are ignored. A name model (character
    trigrams of the names, per language) is trained first, on all files that neither their path nor a notice gives away: names
    that fit no language's model and are very short are mangled. Few trigrams among many names, or few line shapes among many
    lines, make a template, the other naming style than the language's a copy from another project. Lines of literals are bulk
    data. What the models leave is then decided by path and by what comments at the file's head or foot say.
    Files with null content are judged by their path alone, as empty ones are. Repeated rows give repeated rows.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "handmade")
    f = files.select("task_id", "repository_id", "abs", "lang", "content")
    feats = scratch.keep(f.mapInArrow(_features, FEATURES), "features")
    # summed up on the executors first: at most N_GRAMS numbers for each of seven languages reach the driver, however large the corpus
    per = feats.where("counts is not null").select("lang", "camel", "snake", F.posexplode("counts").alias("gram", "n"))
    per = per.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("camel").alias("camel"), F.sum("snake").alias("snake")).where("n > 0")
    rows = per.groupBy("lang").agg(F.max("camel").alias("camel"), F.max("snake").alias("snake"), F.collect_list(F.struct("gram", "n")).alias("c")).collect()
    models: dict[str, np.ndarray] = {}
    norms: list[tuple[str, str]] = []
    for r in rows:
        counts = np.zeros(N_GRAMS, np.int64)
        for gram, n in r["c"]:
            counts[gram] = n
        models[r["lang"]] = model_of(counts)
        a, b = r["camel"], r["snake"]
        if max(a, b) >= 0.8 * (a + b) > 0:
            norms.append((r["lang"], "camel" if a > b else "snake"))
    scored = feats.where("counts is null").drop("counts").mapInArrow(
        _judge(models), FEATURES.replace(", grams binary, counts array<bigint>", "") + ", bits double, reads_like string"
    )
    c = F.col
    norm = F.lit(None).cast("string")
    for lang, s in norms:
        norm = F.when(c("lang") == lang, F.lit(s)).otherwise(norm)
    styled = c("camel") + c("snake")
    other = F.when(norm == "snake", c("camel")).otherwise(c("snake"))
    # a file that reads like another language is in the wrong file, not from another project
    foreign = norm.isNotNull() & (styled >= STYLE_NAMES) & (other >= STYLE_SHARE * styled) & (c("reads_like") == c("lang"))
    reason = (
        F.when((c("bits") >= MANGLED_BITS) & (c("short_share") >= SHORT_SHARE), "mangled")
        .when((c("longest_code") >= LONG_CODE) & (c("short_share") >= SHORT_SHARE), "packed")
        .when(c("name_diversity") < NAME_DIVERSITY, "template")
        .when((c("diversity") < DIVERSITY) & (c("n_lines") >= DIVERSE_LINES), "template")
        .when((c("data_share") >= DATA_SHARE) & (c("n_chars") >= DATA_CHARS), "data")
        .when(foreign, "style")
        .when(c("bundle") > 0, "bundle")
        .when(c("path_says") != "", c("path_says")).when(c("tool"), "tool").when(c("copied"), "copied")
    )
    return scored.withColumn("reason", reason)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand for their repository."""
    return classify(all_task_files(spark, sf_dir)).where("reason is not null").select("task_id")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and language, how many files there are of each reason, hand-written ones as ``hand``."""
    per = classify(all_task_files(spark, sf_dir)).groupBy("repository_id", "lang", F.coalesce("reason", F.lit("hand")).alias("reason"))
    return per.agg(F.count(F.lit(1)).alias("n_files"))


def p5_hand_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's nodes that lie in hand-written files: node_id, repository_id, file.

    ``nodes.file`` is cleaned as a path and compared as written; a node whose file is null or no task's stays.
    """
    from graphloom.functions.ids import clean
    from graphloom.functions.paths import clean_path
    from graphloom.sources.tables import table

    files = all_task_files(spark, sf_dir)
    bad = classify(files).where("reason is not null").select("task_id")
    path = F.regexp_replace("abs", r"^/srv/checkouts/[^/]+/", "")
    paths = files.select("task_id", "repository_id", path.alias("file")).join(bad, "task_id").select("repository_id", "file").distinct()
    nodes = table(spark, sf_dir, "nodes").select(clean("node_id").alias("node_id"), "repository_id", clean_path(F.col("file")).alias("file")).distinct()
    return nodes.join(paths, ["repository_id", "file"], "left_anti").select("node_id", "repository_id", "file")


QUERIES = {"p5_found": p5_found, "p5_reasons": p5_reasons, "p5_hand_nodes": p5_hand_nodes}
ORACLE: dict[str, str] = {}
