import random

from graphloom.llm.p9_sentences import split_sentences
from graphloom.llm.sentences import looks_like_chat, sentences


def cut(text):
    return [text[s:e] for s, e in sentences(text, looks_like_chat(text))]


def test_scripts_and_marks():
    assert cut("One is 3.5 long. Two (see A. B.) ends! 三つ目です。四つ目。") == ["One is 3.5 long.", "Two (see A. B.) ends!", "三つ目です。", "四つ目。"]
    assert cut("He said “Stop. Now.” and left. Then he ran.") == ["He said “Stop. Now.” and left.", "Then he ran."]
    assert cut("# Title\n\n- item one\n- item two. And more.\n\nEnd") == ["Title", "item one", "item two.", "And more.", "End"]
    assert cut("hi there\nhow are you\nfine") == ["hi there", "how are you", "fine"]
    assert cut("यह पहला है। यह दूसरा है।") == ["यह पहला है।", "यह दूसरा है।"]


def test_evidence_of_the_document_comes_first():
    # no list knows this abbreviation
    text = "The qvx. of it is small. A qvx. was seen, a qvx. is here. Then qvx. and more."
    assert cut(text)[0] == "The qvx. of it is small."
    corpus = frozenset({"Aqvx", "PMaskeli"})
    got = sentences("One qvx. Maskeli spoke. It ended.", False, corpus)
    assert len(got) == 2


def test_offsets_are_whole(spark):
    rnd = random.Random(3)
    texts = [None, "", "  \n ", "a" * 50_000, "." * 500, "x. " * 4000, "́. A", "👩‍💻 ok. Next."]
    texts += ["".join(rnd.choice("ab .!?。\n“”()A") for _ in range(200)) for _ in range(60)]
    df = spark.createDataFrame([(i if i != 4 else None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, own string")
    seen = {}
    for r in split_sentences(df).collect():
        seen.setdefault(r["doc_id"], []).append((r["nr"], r["start_at"], r["end_at"]))
    for i, rows in seen.items():
        if i is None:
            continue
        text, end = texts[i], 0
        for n, (nr, s, e) in enumerate(sorted(rows)):
            assert nr == n and end <= s < e <= len(text) and not text[s].isspace() and not text[e - 1].isspace()
            end = e
    assert not {0, 1, 2} & set(seen) and len(seen[5]) >= 1
