"""Betweenness for graphs of a bounded size."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import Scratch

LIMIT = 5000  # nodes; the adjacency of a graph this size is at most 25 million pairs and checked below
MAX_PAIRS = 1_000_000


def betweenness(ids: DataFrame, pairs: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """(id, score): Brandes' betweenness on directed unweighted pairs, without loops; 0 for all above ``limit`` nodes or MAX_PAIRS pairs.

    The measure needs a search from every node, so it is for graphs (or contractions of graphs) whose size is checked first; those
    pairs go to every task, the sources are spread over the tasks. Larger graphs weigh it 0, as documented in ``importance``.
    """
    ids = scratch.keep(ids.select("id").where("id is not null").distinct(), "ids")
    pairs = scratch.keep(pairs.select("src", "dst").where("src <> dst").distinct(), "pairs")
    n = ids.count()
    if not n or n > limit or pairs.count() > MAX_PAIRS:
        return ids.withColumn("score", F.lit(0.0))
    nodes = sorted(r["id"] for r in ids.collect())
    place = {v: i for i, v in enumerate(nodes)}
    out: list[list[int]] = [[] for _ in nodes]
    for a, b in sorted((r["src"], r["dst"]) for r in pairs.collect()):
        if a in place and b in place:
            out[place[a]].append(place[b])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = [0.0] * len(nodes)
        for pdf in frames:
            for v in pdf["id"]:
                _from(place[v], out, score)
        yield pd.DataFrame({"id": nodes, "score": score})

    return ids.repartition("id").mapInPandas(search, "id string, score double").groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"))


def _from(s: int, out: list[list[int]], score: list[float]) -> None:
    """Adds what the ways from one source give to every node between."""
    hops, ways, order, before = {s: 0}, {s: 1.0}, [], {s: []}
    queue = deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in out[v]:
            if w not in hops:
                hops[w], ways[w], before[w] = hops[v] + 1, 0.0, []
                queue.append(w)
            if hops[w] == hops[v] + 1:
                ways[w] += ways[v]
                before[w].append(v)
    share = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before[w]:
            share[v] += ways[v] / ways[w] * (1 + share[w])
        if w != s:
            score[w] += share[w]
