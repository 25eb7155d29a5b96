import time

from graphloom.llm.p6_secrets import spans
from graphloom.llm.secrets import blank, candidates
from graphloom.sources.tables import Scratch

COLUMNS = "text_id bigint, task_id bigint, repository_id string, place string, field string, line int, text string"


def values(text):
    return [h.value for h in candidates(text)]


def test_values_of_any_length():
    assert values('client_secret = "' + "aB3dE5gH7" * 60 + '"') == ["aB3dE5gH7" * 60]
    body = "\n".join("Qw3rT5yU8iOp" * 5 + str(n) for n in range(200))
    text = f"x\n-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----\ny"
    assert [(h.start, h.end) for h in candidates(text)] == [(2, len(text) - 2)]


def test_names_and_defaults():
    assert values('ADMIN_PWD = "Maple-harbor-96"') == ["Maple-harbor-96"]
    assert values('KEY_VALUE = ENV.fetch("SVC_GRAPH_KEY", "orchard2022+")') == ["orchard2022+"]
    assert values('DSN = "postgres://app:zBY38yB88Skr@token-75.prod.invalid:6508/x"') == ["zBY38yB88Skr"]
    assert values('password = "${DB_PASSWORD}"') == values('MIN_TOKEN = "Maple-harbor-96"') == []


def test_linear():
    t = time.time()
    candidates("token = " + "a.b " * 5000 + "\n" + "x = f(" * 3000)
    assert time.time() - t < 5


def test_blank_overlap():
    assert blank("abcdefgh", [(1, 4), (2, 6)], "*") == "a*gh"


def test_corpus(spark):
    sample = 'token = "Zx81kLm4Qp77"'
    rows = [(n, n, f"r{n}", "content", "content", None, sample) for n in range(8)]
    rows += [
        (20, 20, "r1", "content", "content", None, 'a\npassword = "Kq7-Trw9vB2x"\n'),
        (21, 21, "r2", "parse", "doc", 7, "It was Kq7-Trw9vB2x once"),
        (22, 22, "r3", "content", "content", None, "# unlike aKq7-Trw9vB2x"),
    ]
    got = spans(spark.createDataFrame(rows, COLUMNS), Scratch(spark, "test")).select("task_id", "place", "line").distinct().collect()
    assert sorted(map(tuple, got)) == [(20, "content", 2), (21, "parse", 7)]
