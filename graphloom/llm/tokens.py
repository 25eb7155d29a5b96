"""Sizes of texts in tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_tokens(text: Column) -> Column:
    """Tokens of a byte-level tokenizer: UTF-8 bytes plus an end token; 0 for null or only white space."""
    blank = text.isNull() | ~text.rlike(r"(?U)\S")
    return F.when(blank, F.lit(0)).otherwise(F.octet_length(text) + 1).cast("long")


def vocabulary_tokens(texts, vocabulary: str):
    """Token counts of an iterable of texts under a ``tokenizers`` vocabulary file, given by its path."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
