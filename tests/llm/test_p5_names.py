from graphloom.llm.handmade import name_diversity
from graphloom.llm.p5_handmade import classify

FILES = "task_id bigint, repository_id string, abs string, lang string, content string"
# no two lines have one shape
MADE = "".join(f"{'  ' * 0}x{'+' * (n % 5)}{'-' * (n // 5)}getFrozenTokenField{chr(97 + n)} = {'(' * n}a{')' * n}\n" for n in range(1, 25))
HAND = "walk merge budget origin ledger parse shard window depth cursor emit flush report anchor symbol digest".split()


def test_names():
    assert name_diversity([f"getFrozenTokenField{chr(97 + n)}" for n in range(24)]) < 0.5
    assert name_diversity(HAND) > 0.5
    # a long file is not less diverse for its length
    assert abs(name_diversity(HAND * 20) - name_diversity((HAND * 20)[:40])) < 0.1


def test_template_by_names(spark):
    hand = "".join(f"{a}{b.title()} = {a}({b}, {n})\n" for n, (a, b) in enumerate(zip(HAND, HAND[1:])))
    rows = [(1, "r", "/srv/checkouts/r/src/a.ts", "ts", MADE), (2, "r", "/srv/checkouts/r/src/b.ts", "ts", "// notes\n" + hand[:200])]
    got = {r["task_id"]: (r["reason"], r["diversity"]) for r in classify(spark.createDataFrame(rows, FILES)).collect()}
    assert got[1][0] == "template" and got[1][1] > 0.25
    assert got[2][0] is None
