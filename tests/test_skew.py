"""Chunked per-key operators with chunks so small that their borders merge."""

import datetime as dt
import random

from pyspark.sql import functions as F

from graphloom.operators.skew import heavy_keys, key_profile, number_rows, running_sum, with_previous
from graphloom.operators.timeline import exposures, kept, within_budget
from graphloom.sources.tables import Scratch

AT = dt.datetime(2024, 1, 1)


def data(n=400, seed=3):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "a", "a", "b", "c", None]), i, rnd.choice([1, 2, 3, None]), rnd.random() < 0.4) for i in range(n)]


def per_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_numbers_sums_and_previous(spark):
    rows = data()
    df = spark.createDataFrame(rows, "k string, o int, v int, f boolean").repartition(7)
    s = Scratch(spark, "test")
    num = {r["o"]: r["_rn"] for r in number_rows(df, ["k"], ["o"], s, "n", 7).collect()}
    before = {r["o"]: r["_before"] for r in running_sum(df, ["k"], ["o"], "v", s, "s", 7).collect()}
    prev = {r["o"]: r["prev_v"] for r in with_previous(df, ["k"], ["o"], ["v"], s, "p", 7).collect()}
    assert len(num) == len(before) == len(prev) == len(rows)
    for group in per_key(rows).values():
        total, last = 0, None
        for i, (_, o, v, _) in enumerate(group):
            assert (num[o], before[o], prev[o]) == (i, total, last)
            total, last = total + (v or 0), v


def test_profile_and_heavy(spark):
    rows = [(k or "z", AT + dt.timedelta(seconds=o * (1 + o % 5))) for k, o, _, _ in data()]
    df = spark.createDataFrame(rows, "k string, at timestamp")
    s = Scratch(spark, "test")
    got = {r["k"]: (r["n_rows"], r["longest_gap_s"]) for r in key_profile(df, "k", "at", s, "a", 5).collect()}
    for k, group in per_key(rows).items():
        ts = sorted(t for _, t in group)
        assert got[k] == (len(ts), max(((b - a).total_seconds() for a, b in zip(ts, ts[1:])), default=None))
    heavy = {r["k"] for r in heavy_keys(df.select("k"), "k", 4, s, "h", 11).collect()}
    assert heavy == {k for k, g in per_key(rows).items() if len(g) * 4 >= len(rows)}


def test_exposures(spark, monkeypatch):
    import graphloom.operators.skew as skew

    for f in (skew.running_sum, skew.with_previous):
        monkeypatch.setattr(f, "__defaults__", (5,))
    rows = data(300)
    df = spark.createDataFrame(rows, "k string, o int, v int, f boolean")
    got = sorted((r["k"] or "", r["started"], r["ended"]) for r in exposures(df, ["k"], ["o"], "o", "f", Scratch(spark, "test")).collect())
    want = []
    for k, group in per_key(rows).items():
        start = None
        for _, o, _, f in group:
            if f and start is None:
                start = o
            elif not f and start is not None:
                want.append((k or "", start, o))
                start = None
        if start is not None:
            want.append((k or "", start, None))
    assert got == sorted(want, key=lambda x: x[:2])


def test_kept_and_budget(spark):
    rnd = random.Random(5)
    rows, t = [], 0
    for i in range(200):
        t += rnd.randint(0, 9) * 3600
        rows.append((rnd.choice("ab"), AT + dt.timedelta(seconds=t), rnd.choice(["x", "x", "y"]), float(rnd.randint(0, 4))))
    df = spark.createDataFrame(rows, "k string, ts timestamp, v string, c double").withColumn("id", F.monotonically_increasing_id())
    got = sorted((r["k"], r["ts"], r["v"]) for r in kept(df, ["k"], ["ts", "id"], "ts", "v", 86400, Scratch(spark, "test")).collect())
    want = []
    for k, group in per_key(rows).items():
        last = None
        for _, ts, v, _ in group:
            if last is None or v != last[1] or (ts - last[0]).total_seconds() >= 86400:
                last = (ts, v)
                want.append((k, ts, v))
    assert got == sorted(want)
    n = {r["k"]: r["n"] for r in within_budget(df, ["k"], ["ts", "id"], "c", 20.0, Scratch(spark, "test")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k, group in per_key(rows).items():
        used, c = 0.0, 0
        for i, r in enumerate(group):
            used += r[3]
            c += i == 0 or used <= 20
        assert n[k] == c
