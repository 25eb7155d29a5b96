"""Trees, chains, forests and loops against plain walks."""

import random

from pyspark.sql import functions as F

from graphloom.operators.hierarchy import Hierarchy


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "node string, parent string").select(F.encode("node", "UTF-8").alias("node"), F.encode("parent", "UTF-8").alias("parent"))


def text(x):
    return None if x is None else bytes(x).decode()


def walk(pairs):
    up = dict(pairs)
    nodes = set(up) | {p for p in up.values() if p}
    root, depth, cyc = {}, {}, {}
    for n in nodes:
        seen, x = [n], n
        while up.get(x) and up[x] not in seen:
            x = up[x]
            seen.append(x)
        if not up.get(x):
            root[n], depth[n] = x, len(seen) - 1
        elif up[x] == n:
            cyc[n] = min(seen)
    return root, depth, cyc


def check(spark, pairs):
    h = Hierarchy(frame(spark, pairs))
    root, depth, cyc = walk(pairs)
    assert {text(r["node"]): text(r["cycle"]) for r in h.cycles().collect()} == cyc
    sets = {text(r["node"]): (text(r["root"]), r["depth"], r["pre"], r["size"]) for r in h.nested_sets().collect()}
    assert {n: (r, d) for n, (r, d, _, _) in sets.items()} == {n: (root[n], depth[n]) for n in root}
    up = dict(pairs)
    below = {n: set() for n in root}
    for n in root:
        x = n
        while up.get(x):
            x = up[x]
            below[x].add(n)
    for n, (r, _, pre, size) in sets.items():
        assert size == len(below[n]) + 1
        assert {m for m, (r2, _, p2, _) in sets.items() if r2 == r and pre < p2 < pre + size} == below[n]
    paths = {text(r["node"]): [text(x) for x in r["path"]] for r in h.paths().collect()}
    for n in root:
        p = [n]
        while up.get(p[0]):
            p.insert(0, up[p[0]])
        assert paths[n] == p
    want = sorted((a, d) for a in root for d in below[a])
    all_nodes = h.nested_sets().select("node")
    assert sorted((text(r["node"]), text(r["descendant"])) for r in h.descendants(all_nodes).collect()) == want


def test_forest(spark):
    rnd = random.Random(1)
    check(spark, [(f"n{i:03}", f"n{rnd.randrange(i):03}" if rnd.random() > 0.1 else None) for i in range(1, 120)])


def test_chain_and_loops(spark):
    chain = [(f"c{i:03}", f"c{i - 1:03}") for i in range(1, 40)]
    loops = [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("deeper", "below"), ("self", "self"), ("p", "q"), ("q", "p")]
    check(spark, chain + loops)


def test_hot_parent_and_empty(spark):
    check(spark, [(f"k{i:03}", "root") for i in range(150)] + [("leaf", "k001")])
    h = Hierarchy(frame(spark, []))
    assert h.cycles().count() == h.nested_sets().count() == h.paths().count() == 0
