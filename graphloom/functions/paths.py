"""File paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column | str) -> Column:
    """A relative path with ``/``: trimmed, backslashes turned, ``./``, doubled and leading slashes and the checkout's root removed."""
    p = F.col(path) if isinstance(path, str) else path
    p = F.regexp_replace(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""), r"\\", "/")
    p = F.regexp_replace(p, r"^/srv/checkouts/[^/]+/", "")
    p = F.regexp_replace(p, r"^file://", "")
    p = F.regexp_replace(p, r"/(?:\./)+", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    return F.regexp_replace(p, r"^(?:\./|/)+", "")


def directory(path: Column) -> Column:
    """What stands before the last ``/``, or the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The letters and digits behind the last dot of the base name, in lower case; '' for none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([A-Za-z0-9]+)$", 1))


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest first; the root is not among them."""
    parts = F.split(directory(path), "/")
    n = F.size(parts)
    return F.when(directory(path) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), n - i), "/"))
    )


def join_relative(folder: Column, spec: Column) -> Column:
    """``spec`` (``./a``, ``../b/c``) resolved against ``folder``, ``.`` and ``..`` folded; null when it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(folder != "", folder), spec), "/"), lambda x: (x != "") & (x != "."))
    out = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(acc.isNull(), acc).when(x != "..", F.concat(acc, F.array(x))).when(
            F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ),
    )
    return F.array_join(out, "/")


# Conventions of test files; those in capitals are told by the base name as it is written.
_TEST_DIRS = r"(^|/)(__tests__|__test__|tests?|specs?)/"
_TEST_LOWER = r"\.(test|spec)\.[cm]?[jt]sx?$|^test_.*\.py$|_test\.(py|go|rb)$|_spec\.rb$"
_TEST_CASED = r"[A-Za-z0-9](Test|Tests|IT)\.java$|[A-Za-z0-9](Test|Tests)\.(cs|swift)$"


def is_test_file(path: Column) -> Column:
    """Whether a path is a test file by the conventions of its language; null stays null."""
    base = base_name(path)
    return F.lower(path).rlike(_TEST_DIRS) | F.lower(base).rlike(_TEST_LOWER) | base.rlike(_TEST_CASED)


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ``**/`` any directories, ``**`` anything, ``*`` and ``?`` within a directory, ``{a,b}`` choices."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in r"\.+^$()[]{}|" else c
        i += 1
    return f"^{out}$"


# Directories that discovery never enters.
SKIPPED_DIRS = (
    "node_modules", "dist", "build", "out", "target", "vendor", "coverage", "bin", "obj", "venv", "env", "__pycache__", "site-packages", "bower_components",
)


def skipped(path: Column) -> Column:
    """Whether any directory of the path is one that discovery never enters, or starts with a dot."""
    return path.rlike(r"(^|/)(" + "|".join(SKIPPED_DIRS) + r")/|(^|/)\.[^/]+/")
