from pyspark.sql import functions as F

from graphloom.functions import paths as ps
from graphloom.functions import text as tx
from graphloom.functions import versions as vs
from graphloom.operators import retrieval as rt


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_paths(spark):
    assert one(spark, " .\\a\\\\b//./c.ts ", ps.clean_path) == "a/b/c.ts"
    assert one(spark, "a/b/c.ts", ps.ancestors) == ["a/b", "a"]
    assert one(spark, "c.ts", ps.ancestors) == []
    for p, want in (("src/a.test.ts", True), ("tests/x.py", True), ("src/FooTest.java", True), ("src/contest.java", False), ("a_test.go", True), ("latest/a.go", False), (None, None)):
        assert one(spark, p, ps.is_test_file) == want
    import re

    assert re.match(ps.glob_regex("src/**/*.{ts,js}"), "src/a/b/c.ts") and not re.match(ps.glob_regex("src/*.ts"), "src/a/b.ts")


def test_versions(spark):
    assert tuple(one(spark, "v1.2", vs.version)) == (1, 2, 0)
    assert one(spark, "latest", vs.version) is None
    rows = [("1.2.3", "^1.0.0", True), ("2.0.0", "^1.9.9", False), ("0.2.5", "^0.2.1", True), ("0.3.0", "^0.2.1", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.2.3", "1.2", True), ("1.2.3", "*", True), ("1.2.3", ">=2", False)]
    df = spark.createDataFrame(rows, "v string, s string, want boolean")
    assert [r["got"] for r in df.select(vs.satisfies(vs.version(F.col("v")), F.col("s")).alias("got")).collect()] == [r[2] for r in rows]


def test_text(spark):
    assert one(spark, "parseHTTPRequest_v2", tx.identifier_parts) == ["parse", "http", "request", "v2"]
    md = "lead\n# One\ntext\n\n```\n# no heading here? it is one\n```\n## Two  \n\n# \nbody"
    got = [(s["heading"], s["level"]) for s in one(spark, md, tx.sections)]
    assert got == [("", 0), ("One", 1), ("no heading here? it is one", 1), ("Two", 2)]
    assert one(spark, "a\nb\n\n```\nx\n\ny\n```\n\nc", tx.chunks) == ["a\nb\n", "```\nx\n\ny\n```\n", "c"]
    assert one(spark, "key ghp_abcdefgh12345678 and password: hunter22", tx.redact) == "key [REDACTED] and [REDACTED]"
    assert one(spark, "https://u:p@h.x/a?token=1&b=2", tx.strip_url_credentials) == "https://h.x/a?b=2"
    assert one(spark, "(MIT OR GPL-3.0-or-later WITH x)", tx.licence_ids) == ["MIT", "GPL-3.0"]
    assert one(spark, "MIT OR GPL-3.0", tx.licence_risk) == "low" and one(spark, "MIT AND GPL-3.0", tx.licence_risk) == "high"
    assert tuple(one(spark, "ghcr.io/a/b:1.2", tx.image_ref))[:3] == ("ghcr.io", "a/b", "1.2")
    assert tuple(one(spark, "git@github.com:o/r.git", tx.git_url)) == ("github.com", "o", "r")
    assert one(spark, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", tx.cvss3) == 9.8
    assert one(spark, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", tx.cvss3) == 10.0
    assert one(spark, "CVSS:2.0/AV:N", tx.cvss3) is None
    assert one(spark, None, tx.redact) is None
    assert one(spark, 'see "exact phrase" at https://a.b/c', tx.needles) == ["https://a.b/c", "exact phrase"]


def test_cosine_blocks_agree(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, [rnd.random() for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = e.where("vec_id % 5 = 0")
    a = sorted(tuple(r) for r in rt.cosine_topk(e, q, 3).collect())
    b = sorted(tuple(r) for r in rt.cosine_topk(e, q, 3, block=4).collect())
    assert a == b and len(a) == 3 * q.count()


def test_scan_and_fuse(spark):
    d = spark.createDataFrame([(1, "One\ntwo TOKEN x\n"), (2, None), (3, "")], "id int, text string")
    assert [(r["id"], r["needle"], r["line"]) for r in rt.literal_scan(d, "text", ["token", "zzz"], ["id"]).collect()] == [(1, "token", 2)]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    got = {r["id"]: r["score"] for r in rt.fuse([a, b], ["id"]).collect()}
    assert got["y"] > got["x"]
