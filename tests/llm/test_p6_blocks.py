import graphloom.llm.p6_secrets as p6
from graphloom.llm.p6_secrets import spans
from graphloom.sources.tables import Scratch


def test_blocks_change_nothing(spark, monkeypatch):
    # no run of four letters or digits in these passwords
    code = [f'password = "a{i}!b#{i}%c_{i}-d?Z"\nother = 1\n' for i in range(6)]
    note = "also a1!b#1%c_1-d?Z here\n"
    rows = [(i, i, f"r{i}", "content", "content", None, x) for i, x in enumerate([*code, note])]
    t = spark.createDataFrame(rows, p6.TEXTS)
    one = sorted((r["text_id"], r["start_at"], r["end_at"]) for r in spans(t, Scratch(spark, "t")).distinct().collect())
    assert {i for i, _, _ in one} >= {0, 1, 2, 3, 4, 5}
    monkeypatch.setattr(p6, "BLOCK", 2)
    assert sorted((r["text_id"], r["start_at"], r["end_at"]) for r in spans(t, Scratch(spark, "t")).distinct().collect()) == one


def test_long_values_and_keys(spark):
    body = "A1b2C3d4" * 3000
    rows = [(1, 1, "r", "content", "content", None, f'key = """-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"""\n'), (2, 2, "r", "content", "content", None, ""), (3, 3, "r", "content", "content", None, "x" * 200_000)]
    got = {r["text_id"] for r in spans(spark.createDataFrame(rows, p6.TEXTS), Scratch(spark, "t")).collect()}
    assert got == {1}
