from graphloom.llm.p9_sentences import split_sentences
from graphloom.llm.sentences import sentences

SEEN = "The Abg., it is said, spoke. Then the Abg. was silent. Later the Abg., too, and the Abg. again. "
NAMES = "We saw how Orrinde left and why Orrinde came. "
LAST = "Yesterday Abg. Orrinde voted. The Abg. Then came home."


def parts(text, spans):
    return [text[a:b] for a, b in spans]


def test_learned_abbreviation_before_learned_name():
    text = SEEN + NAMES + LAST
    got = parts(text, sentences(text, False))
    assert "Yesterday Abg. Orrinde voted." in got
    # what is no name still starts a sentence
    assert got[-2:] == ["The Abg.", "Then came home."]


def test_word_that_is_no_abbreviation():
    text = NAMES + "He read the report. Orrinde did not."
    assert parts(text, sentences(text, False))[-1] == "Orrinde did not."


def test_corpus_knows(spark):
    texts = [SEEN, NAMES, "Yesterday Abg. Orrinde voted."]
    rows = split_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert [(r["start_at"], r["end_at"]) for r in rows if r["doc_id"] == 2] == [(0, len(texts[2]))]
