import random

from graphloom.llm.p2_pieces import split_pieces

WORDS = ["wort", "日本語", "données", "x" * 30, "…", "हिन्दी", "a.b"]


def test_pieces_cover_the_text(spark):
    rnd = random.Random(4)
    texts = ["", None, "short", "y" * 5000, "語" * 3000, "\n" * 900]
    for _ in range(12):
        texts.append("".join(rnd.choice(WORDS) + rnd.choice([" ", ". ", "\n", "\n\n", ", ", "", "。"]) for _ in range(rnd.randrange(50, 3000))))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string").withColumnRenamed("id", "nr_of_doc")
    limit, overlap = 512, 64
    out = {}
    for r in split_pieces(df, "body", limit, overlap).collect():
        out.setdefault(r["nr_of_doc"], []).append(r)
    for i, text in enumerate(texts):
        if not text:
            assert i not in out
            continue
        raw, at = text.encode(), 0
        pieces = sorted(out[i], key=lambda r: r["nr"])
        assert [r["nr"] for r in pieces] == list(range(pieces[0]["n_pieces"]))
        for r in pieces:
            b = r["piece"].encode()
            assert len(b) == r["n_bytes"] <= limit and raw[r["start_byte"] :].startswith(b)
            assert r["start_byte"] + r["overlap_bytes"] == at
            assert r["nr"] == 0 and not r["overlap_bytes"] or overlap - 3 <= r["overlap_bytes"] <= overlap
            at = r["start_byte"] + r["n_bytes"]
        assert at == len(raw)


def test_natural_ends(spark):
    body = ("Sentence number one is here. " * 10 + "\n\n") * 20
    got = split_pieces(spark.createDataFrame([(body,)], "body string"), "body", 1000, 50).orderBy("nr").collect()
    assert all(r["piece"].endswith("\n\n") for r in got)
    assert got[0]["n_bytes"] > 1000 - 50 or got[0]["piece"].endswith("\n\n")
