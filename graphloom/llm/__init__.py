"""Operators for language-model training data; nothing outside this package imports it."""

QUERY_MODULES = ["p1_syntax", "p2_pieces", "p5_handmade", "p6_secrets", "p7_packing", "p8_mixing", "p9_sentences"]
