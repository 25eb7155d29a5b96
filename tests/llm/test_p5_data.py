import time

from graphloom.llm.handmade import shape


def test_long_literals_are_data():
    blob = '["' + "aGVsbG8g" * 1000 + '"]'
    assert shape(blob, "js")["data_share"] > 0.9


def test_code_behind_literals_is_not():
    line = "1, " * 2000 + "call(x)"
    assert shape(line, "js")["data_share"] == 0


def test_linear():
    t = time.time()
    assert shape("1" * 200_000 + "x", "js")["data_share"] == 0
    assert time.time() - t < 2
