"""Retrieval: term weights, tiered lexical scores, lookups, literal sweeps, vector search, rank fusion.

A question is a handful of terms, so it enters the plan as literals: nodes are scored row by row without a join or shuffle, and a
top-k keeps k rows a task. Searches with many queries go over the rows in blocks of queries of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numbers import half_up
from graphloom.functions.paths import directory
from graphloom.functions.text import alike, identifier_parts
from graphloom.operators.graph import top_per_key

BLOCK_QUERIES = 8192  # queries held at once: with 64 numbers each, 4 MB


def idf(names: DataFrame, terms: Sequence[str], name: str = "name") -> DataFrame:
    """(term, df, weight): ln((N + 1) / (df + 1)) + 1 held between 0.5 and 8, df the names with the term as a part or within. One pass, no join."""
    parts, low = identifier_parts(F.col(name)), F.lower(name)
    hit = [F.count_if(F.array_contains(parts, t) | low.contains(t)).alias(f"t{i}") for i, t in enumerate(terms)]
    row = names.agg(F.count(F.lit(1)).alias("n"), *hit)
    x = row.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)])).alias("x")).select("n", "x.term", "x.df")
    w = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return x.select("term", "df", half_up(F.least(F.greatest(w, F.lit(0.5)), F.lit(8.0)), 6).alias("weight"))


def lexical(nodes: DataFrame, terms: Sequence[tuple[str, float, bool]], importance: float = 0.4) -> DataFrame:
    """Nodes (name, qname, file, importance) with ``score`` > 0 for terms (term, weight, weak).

    Each term counts by its first tier: the name (10), a part of it (6), within it (4), within the qualified name (3), a part of
    the same root (2), a directory (2), within the path (1). Weak terms weigh a quarter and never carry a node alone;
    several content terms multiply (0.35 each, up to four more); importance adds up to 40 %. Null names and files match nothing.
    """
    name, qname, file = F.lower("name"), F.lower("qname"), F.lower("file")
    # the parts are bound to a column once, not once a term
    d = nodes.withColumn("_parts", identifier_parts(F.col("name"))).withColumn("_dirs", F.split(directory(file), "/"))
    parts, dirs = F.col("_parts"), F.col("_dirs")
    score, hits = F.lit(0.0), F.lit(0)
    for t, weight, weak in terms:
        tier = (
            F.when(name == t, 10.0).when(F.array_contains(parts, t), 6.0).when(name.contains(t), 4.0).when(qname.contains(t), 3.0)
            .when(F.exists(parts, _like(t)), 2.0).when(F.array_contains(dirs, t), 2.0).when(file.contains(t), 1.0).otherwise(0.0)
        )
        score = score + tier * F.lit(weight * (0.25 if weak else 1.0))
        if not weak:
            hits = hits + (tier > 0).cast("int")
    d = d.withColumn("_score", score).withColumn("_hits", hits).where("_hits > 0")
    s = F.col("_score") * (1 + 0.35 * F.least(F.col("_hits") - 1, F.lit(4))) * (1 + importance * F.coalesce("importance", F.lit(0.0)))
    return d.withColumn("score", half_up(s, 6)).drop("_parts", "_dirs", "_score", "_hits")


def _like(term: str):
    return lambda part: alike(part, F.lit(term))


def cascade(nodes: DataFrame, needle: str, limit: int = 25) -> DataFrame:
    """Nodes found by the first tier that finds any: id, file, qualified name, name, name without case, within the name; adds ``tier``.

    The first non-empty tier is one aggregate over rows that match at all.
    """
    low = needle.lower()
    tier = (
        F.when(F.col("id") == low, 1).when(F.col("file") == needle, 2).when(F.col("qname") == needle, 3).when(F.col("name") == needle, 4)
        .when(F.lower("name") == low, 5).when(F.lower("name").contains(low), 6)
    )
    hit = nodes.withColumn("tier", tier).where("tier is not null")
    best = hit.agg(F.min("tier").alias("best"))
    return hit.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best").orderBy("name", "id").limit(limit)


def literal_scan(docs: DataFrame, text: str, needles: Sequence[str], keep: Sequence[str], preview: int = 120) -> DataFrame:
    """(keep, needle, line, preview): every line that holds a needle, without case; lines count from 1. Texts without any needle are not split."""
    low = F.lower(text)
    some = docs.where(_any([low.contains(n.lower()) for n in needles]))
    lines = some.select(*keep, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    found = F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.lower(F.col("_line")).contains(F.lower(n)))
    return lines.select(*keep, F.explode(found).alias("needle"), (F.col("_i") + 1).alias("line"), F.substring(F.trim("_line"), 1, preview).alias("preview"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def cosine_topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, id, score, rank): the k rows nearest by cosine to each query, itself left out; ties to the smallest id.

    Queries are taken in blocks of a fixed size; each block passes over the rows once as matrix products, a task keeps k rows a
    query before the shuffle. Vectors of another length are cut to the shorter; a zero or null vector scores 0 or is left out.
    """
    n = queries.count()
    out = None
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b) if blocks > 1 else queries
        held = [(r[id_col], np.asarray(r[vec], np.float64)) for r in part.where(F.col(vec).isNotNull()).select(id_col, vec).collect()]
        got = rows.where(F.col(vec).isNotNull()).select(id_col, vec).mapInArrow(_nearest(held, k), "query_id bigint, id bigint, score double")
        out = got if out is None else out.unionByName(got)
    return top_per_key(out, ["query_id"], [F.desc("score"), "id"], k)


def _nearest(held: list[tuple[int, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = max((len(v) for _, v in held), default=0)
        q = np.zeros((len(held), dims))
        for i, (_, v) in enumerate(held):
            q[i, : len(v)] = v
        norm = np.linalg.norm(q, axis=1)
        qid = np.array([i for i, _ in held], np.int64)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(held)
        for b in batches:
            ids, vecs = b[0].to_numpy(zero_copy_only=False), b[1].to_pylist()
            m = np.zeros((len(vecs), dims))
            for i, v in enumerate(vecs):
                v = v[:dims]
                m[i, : len(v)] = v
            other = np.linalg.norm(m, axis=1)
            scale = np.outer(norm, other)
            s = np.divide(q @ m.T, scale, out=np.zeros_like(scale), where=scale > 0)
            s = np.floor(s * 1e6 + 0.5) / 1e6
            for i in range(len(held)):
                ok = ids != qid[i]
                a = np.concatenate([best[i][0], ids[ok]])
                c = np.concatenate([best[i][1], s[i][ok]])
                top = np.lexsort((a, -c))[:k]
                best[i] = (a[top], c[top])
        rows = [(np.full(len(a), qid[i]), a, c) for i, (a, c) in enumerate(best) if len(a)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=["query_id", "id", "score"])

    return run


def fuse(lists: Sequence[DataFrame], key: Sequence[str], rank: str = "rank", k: int = 60) -> DataFrame:
    """(key, score): the sum of 1 / (k + rank) over the ranked lists a row is in. A union and one aggregate, no outer join."""
    out = None
    for x in lists:
        x = x.select(*key, (1.0 / (k + F.col(rank))).alias("_s"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy(*key).agg(half_up(F.sum("_s"), 9).alias("score"))
