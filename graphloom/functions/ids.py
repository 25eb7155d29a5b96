"""Cleaning and packing of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column | str) -> Column:
    """Trimmed of all white space (Unicode too) and in lower case; null stays null, blank becomes ''."""
    c = F.col(c) if isinstance(c, str) else c
    # most ids are clean: one look over printable ASCII without capitals saves the rewriting
    return F.when(c.rlike(r"^[!-@\[-~]+\z"), c).otherwise(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))


def clean_or_null(c: Column | str) -> Column:
    """As ``clean``, but blank is null."""
    return F.nullif(clean(c), F.lit(""))


def pack(c: Column | str) -> Column:
    """A cleaned id as bytes, one to one: 32 hex digits become 16 bytes, anything else its UTF-8
    bytes behind 16 bytes of 0xFF (so never 16 bytes long). Halves what joins and groups shuffle."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^[0-9a-f]{32}$"), F.unhex(c)).otherwise(
        F.concat(F.unhex(F.lit("FF" * 16)), F.encode(c, "UTF-8"))
    )


def unpack(c: Column | str) -> Column:
    """The inverse of ``pack``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == 16, F.lower(F.hex(c))).otherwise(
        F.decode(F.substring(c, 17, 2147483647), "UTF-8")
    )
