"""Versions as columns: leniently read numbers that compare in order, ranges and jumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = r"(\d{1,9})(?:\.(\d{1,9}))?(?:\.(\d{1,9}))?"


def version(text: Column) -> Column:
    """struct(major, minor, patch) of the first run of numbers, missing parts 0; null where there is no number. Structs compare in order."""

    def part(i: int) -> Column:
        return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, _NUMBERS, i), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))

    return F.when(text.rlike(r"\d"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def strict(text: Column) -> Column:
    """Whether a text is a full version (three numbers, perhaps a pre-release or build) rather than a range or a word."""
    return F.coalesce(text.rlike(r"^v?\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"), F.lit(False))


def in_window(v: Column, introduced: Column, fixed: Column) -> Column:
    """``introduced <= v < fixed`` over version structs; a null bound is open; a null version is in no window."""
    low = introduced.isNull() | (v >= introduced)
    return F.coalesce(v.isNotNull() & low & (fixed.isNull() | (v < fixed)), F.lit(False))


def upgrade_window(v: Column, start: Column, end: Column) -> Column:
    """``start < v <= end``."""
    return F.coalesce((v > start) & (v <= end), F.lit(False))


def satisfies(v: Column, spec: Column) -> Column:
    """Whether a version struct satisfies ``*``, ``^a``, ``~a``, ``>=a``, ``<a``, an x-range (``1.2``) or an exact version; null for other forms."""
    s = F.regexp_replace(spec, r"\s+", "")
    base = version(s)
    dots = F.regexp_count(s, F.lit(r"\."))
    caret = F.when(base["major"] > 0, v["major"] == base["major"]).when(base["minor"] > 0, (v["major"] == 0) & (v["minor"] == base["minor"])).otherwise(v == base)
    same = (v["major"] == base["major"]) & (v["minor"] == base["minor"])
    return (
        F.when(s.isin("*", "", "latest", "x"), v.isNotNull()).when(s.startswith("^"), (v >= base) & caret).when(s.startswith("~"), (v >= base) & same)
        .when(s.startswith(">="), v >= base).when(s.startswith(">"), v > base).when(s.startswith("<="), v <= base).when(s.startswith("<"), v < base)
        .when(s.rlike(r"^=?v?\d+\.\d+\.\d+"), v == base).when(s.rlike(r"^=?v?\d"), (v["major"] == base["major"]) & ((dots == 0) | (v["minor"] == base["minor"])))
    )


def range_kind(spec: Column) -> Column:
    """How tightly a declared version binds: exact, tilde, caret, partial, any or other."""
    s = F.regexp_replace(F.coalesce(spec, F.lit("")), r"\s+", "")
    return (
        F.when(s.isin("", "*", "latest", "x"), "any").when(s.startswith("^"), "caret").when(s.startswith("~"), "tilde")
        .when(s.rlike(r"^=?v?\d+\.\d+\.\d+"), "exact").when(s.rlike(r"^=?v?\d"), "partial").otherwise("other")
    )


def jump(a: Column, b: Column) -> Column:
    """major, minor, patch, none or downgrade, from version ``a`` to ``b``; null where either is unknown."""
    return F.when(a.isNull() | b.isNull(), None).when(b < a, "downgrade").when(b["major"] > a["major"], "major").when(b["minor"] > a["minor"], "minor").when(b > a, "patch").otherwise("none")


def majors_between(a: Column, b: Column) -> Column:
    """The major versions strictly between two majors, in order; empty where there is none."""
    return F.when(b - a > 1, F.sequence(a + 1, b - 1)).otherwise(F.array().cast("array<int>"))
