from pyspark.sql import functions as F

from graphloom.operators import graph as g
from graphloom.operators import joins as j
from graphloom.operators.aggregates import argmax, majority, nearest_rank_by_count, same_sets
from graphloom.sources.tables import Scratch

EDGE = "edge_id string, kind string, src string, dst string, confidence double, kind_2 string"


def edges(spark, rows):
    return g.collapse(spark.createDataFrame([("e", k, s, d, c, "extra") for k, s, d, c in rows], EDGE))


def test_collapse_cleans_and_folds(spark):
    e = edges(spark, [(" Call", "A ", "b", 0.5), ("call", "a", "B", 0.9), ("call", "a", None, 1.0), ("call", " ", "b", 1.0), (None, "a", "b", 1.0), ("call", "a", "c", None)])
    assert sorted(tuple(r) for r in e.collect()) == [("call", "a", "b", 2, 0.9), ("call", "a", "c", 1, 0.5)]


def test_loops_are_components(spark):
    p = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "f"), ("g", "a"), ("x", "y"), ("y", "x")]
    got = {r["id"]: r["loop"] for r in g.loops(spark.createDataFrame(p, "src string, dst string"), Scratch(spark, "t")).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "d": "e", "e": "e", "x": "y", "y": "y"}
    assert g.loops(spark.createDataFrame([("a", "b")], "src string, dst string"), Scratch(spark, "t")).count() == 0


def test_impact_keeps_the_first_visit(spark):
    e = edges(spark, [("call", "b", "r", 0.9), ("import", "b", "r", 1.0), ("call", "c", "b", 1.0), ("call", "r", "c", 1.0), ("call", "d", "c", 0.5)])
    got, low = g.impact(spark.createDataFrame([("r",)], "root string"), e, Scratch(spark, "t"), 4)
    assert sorted((r["node"], r["depth"], r["confidence"]) for r in got.collect()) == [("b", 1, 0.81), ("c", 2, 0.729), ("d", 3, 0.32805)]
    assert low.first()["min_edge_confidence"] == 0.5


def test_distances_and_tree(spark):
    e = edges(spark, [("call", "a", "b", 1.0), ("call", "b", "a", 1.0), ("call", "b", "c", 1.0), ("call", "a", "a", 1.0)])
    s = spark.createDataFrame([("a",)], "root string")
    assert {r["node"]: r["hops"] for r in g.distances(s, e, Scratch(spark, "t")).collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted(">".join(r["path"]) for r in g.call_tree(s, e, Scratch(spark, "t"), 5).collect()) == ["a", "a>b", "a>b>c"]


def test_enclosing_and_ladder(spark):
    pts = spark.createDataFrame([(1, "f", 5), (2, "f", 50), (3, None, 5), (4, "f", None)], "point_id int, file string, line int")
    spans = spark.createDataFrame([("f", 1, 100, 0, "outer"), ("f", 4, 6, 1, "inner"), ("f", 4, 6, 2, "twin"), ("f", None, 9, 3, "open")], "file string, a int, b int, ord int, name string")
    got = {r["point_id"]: r["name"] for r in j.enclosing(pts, spans, ["file"], "line", "a", "b", ["name"], "ord").collect()}
    assert got == {1: "inner", 2: "outer", 3: None, 4: None}
    calls = spark.createDataFrame([("r", "a", 0, "one"), ("r", "a", 1, "two"), ("r", "a", 2, "far"), ("r", "a", 3, "both"), ("r", "a", 4, "none")], "repo string, rel string, ord int, callee string")
    defs = spark.createDataFrame([("r", "a", 0, "one"), ("r", "a", 1, "two"), ("r", "a", 2, "two"), ("r", "b", 0, "far"), ("r", "b", 1, "both"), ("r", "c", 0, "both")], "repo string, rel string, ord int, name string")
    reach = spark.createDataFrame([("r", "a", "b"), ("r", "a", "c"), ("r", "a", None)], "repo string, rel string, target string")
    out = {r["callee"]: (r["target_rel"], r["rung"]) for r in j.resolve_calls(calls, defs, reach).collect()}
    assert out == {"one": ("a", "file"), "two": ("a", "file-first"), "far": ("b", "reach"), "both": (None, None), "none": (None, None)}


def test_modules(spark):
    files = spark.createDataFrame([("r", "src/a.ts"), ("r", "src/b/c.ts"), ("r", "lib/c.py"), ("r", "x.js")], "repo string, rel string")
    imports = spark.createDataFrame([("r", "src/b/c.ts", "../a.js"), ("r", "src/a.ts", "./b/c"), ("r", "src/a.ts", "../../../x"), ("r", "lib/d.py", "c"), ("r", "src/a.ts", "react"), ("r", "src/a.ts", None)], "repo string, rel string, spec string")
    got = {(r["rel"], r["spec"]): (r["target"], r["how"]) for r in j.resolve_modules(imports, files).collect()}
    assert got == {("src/b/c.ts", "../a.js"): ("src/a.ts", "relative"), ("src/a.ts", "./b/c"): ("src/b/c.ts", "relative"), ("src/a.ts", "../../../x"): (None, "external"), ("lib/d.py", "c"): ("lib/c.py", "suffix"), ("src/a.ts", "react"): (None, "external")}


def test_family_and_precise(spark):
    names = spark.createDataFrame([("n", "i"), ("n", "a"), ("n", "b"), ("m", "x"), ("m", "y")], "name string, id string")
    up = spark.createDataFrame([("a", "i"), ("b", "i")], "src string, dst string")
    assert [tuple(r) for r in j.families(names, up).collect()] == [("n", "i")]
    guess = spark.createDataFrame([("call", "a", "z", 0.4), ("call", "b", "z", 0.4)], "kind string, src string, dst string, conf double")
    sure = spark.createDataFrame([("call", "a", "y", 1.0)], "kind string, src string, dst string, conf double")
    files = spark.createDataFrame([("a", "f"), ("b", "g")], "id string, file string")
    assert sorted((r["src"], r["dst"], r["precise"]) for r in j.merge_precise(guess, sure, files).collect()) == [("a", "y", True), ("b", "z", False)]


def test_votes_ranks_sets(spark):
    d = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 2.0), ("k", "b", 9.0), ("k", None, 3.0), (None, "c", None)], "k string, v string, x double")
    assert [tuple(r) for r in majority(d, ["k"], "v", 0.5, 2).collect()] == [("k", "a", 2, 3)]
    assert sorted((str(r["k"]), r["v"], r["x"]) for r in argmax(d, ["k"], "v", "x").collect()) == [("k", "b", 9.0)]
    assert [tuple(r) for r in nearest_rank_by_count(d, ["k"], "x", 0.5, "p").collect()] == [("k", 2.0)]
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "a")], "k int, m string")
    assert {r["k"]: r["first_k"] for r in same_sets(s, ["k"], "m").collect()} == {1: 1, 2: 1, 3: 3}


def test_betweenness_against_all_ways(spark):
    import itertools
    import random

    from graphloom.operators.centrality import betweenness

    rnd = random.Random(7)
    ids = [f"n{i}" for i in range(9)]
    pairs = {(rnd.choice(ids), rnd.choice(ids)) for _ in range(22)}
    out = {a: [b for x, b in pairs if x == a and b != a] for a in ids}

    def ways(s, t):
        level, found = [[s]], []
        while level and not found:
            level = [[*w, x] for w in level for x in out[w[-1]] if x not in w]
            found = [w for w in level if w[-1] == t]
        return found

    want = dict.fromkeys(ids, 0.0)
    for s, t in itertools.permutations(ids, 2):
        w = ways(s, t)
        for x in w:
            for v in x[1:-1]:
                want[v] += 1 / len(w)
    i, p = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(sorted(pairs), "src string, dst string")
    got = {r["id"]: r["score"] for r in betweenness(i, p, Scratch(spark, "t")).collect()}
    assert all(abs(got[x] - want[x]) < 1e-5 for x in ids)
    assert {r["score"] for r in betweenness(i, p, Scratch(spark, "t"), limit=3).collect()} == {0.0}


def test_communities_by_weight(spark):
    p = [("a", "b", 3.0), ("b", "c", 3.0), ("a", "c", 3.0), ("c", "d", 0.1), ("d", "e", 3.0), ("e", "f", 3.0), ("d", "f", 3.0)]
    ids = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    got = {r["id"]: r["label"] for r in g.communities(ids, spark.createDataFrame(p, "src string, dst string, weight double"), Scratch(spark, "t"), 6).collect()}
    assert got["a"] == got["b"] == got["c"] and got["d"] == got["e"] == got["f"] and got["g"] == "g" and got["a"] != got["d"]
