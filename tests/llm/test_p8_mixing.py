import math

import graphloom.llm.p8_mixing as p8

SIZES = {"a": 1000, "b": 300, "c": 10, "d": 0}
SHARES = {"a": 0.3, "b": 0.5, "c": 0.1, "d": 0.1}
REPEATS = {"a": 1, "b": 3, "c": 2, "d": 5}


def test_exponents_decide(monkeypatch):
    tokens, e = p8.weights(SIZES, SHARES, REPEATS, 1310)
    assert tokens["a"] == 393.0 and tokens["b"] == 655.0 and tokens["c"] == 20 and tokens["d"] == 0
    assert e["a"] == e["b"] == 1.0 and 0 < e["c"] < 1 and e["d"] == 0
    monkeypatch.setattr(p8, "bisect", lambda fits, steps=0: 0.123)
    assert p8.weights(SIZES, SHARES, REPEATS, 1310)[0] != tokens


def test_temperature():
    sizes = {"a": 1000, "b": 100, "c": 10}
    goal = 0.8
    w, e = p8.temperature(sizes, {s: 1000 for s in sizes}, 1110, goal)
    assert abs(p8.entropy(w) - goal) < 1e-6 and 0 < e < 1 and abs(sum(w.values()) - 1) < 1e-12
    w, e = p8.temperature(sizes, {"a": 10, "b": 10, "c": 2}, 1110, math.log(3))
    assert w["c"] * 1110 <= 20 * (1 + 1e-9)
    assert p8.temperature({"a": 0}, {"a": 1}, 0, 0.0)[0] == {"a": 0.0}


def test_draws_keep_the_budget(spark):
    docs = [(i, " A " if i % 3 else "b", 1 + i * 7 % 50) for i in range(300)] + [(300, None, 999), (301, "zzz", 10), (302, "a", None)]
    targets = [("A", 0.2, 1), ("b", 0.7, 2), ("none", 0.1, 3)]
    m = p8.Mix(spark.createDataFrame(docs, "doc_id bigint, source string, size bigint"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    rows = m.draws().collect()
    per = {}
    for r in rows:
        per[r["source"], r["doc_id"]] = per.get((r["source"], r["doc_id"]), 0) + 1
    assert max(per.values()) <= 2 and len({(r["doc_id"], r["pass"]) for r in rows}) == len(rows)
    for s in ("a", "b"):
        got = sum(r["size"] for r in rows if r["source"] == s)
        assert m.tokens[s] - 50 <= got <= m.tokens[s]
    assert m.short == {"none"} | ({"b"} if m.sizes["b"] * 2 < 0.7 * m.total else set())
