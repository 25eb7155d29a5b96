"""Problem 2: pieces under a size limit, cut at natural boundaries, with a set overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.numbers import let
from graphloom.functions.paths import clean_path
from graphloom.sources.tables import table

LIMIT = 8192
OVERLAP = 256


def piece_pattern(limit: int, least: int) -> str:
    """Alternatives by the strength of the boundary they end at; each takes as much as it can.

    The pattern runs over bytes (one character per byte), so that the limit is exact. A paragraph's end
    is taken before a line's end, a sentence's end (Latin, then wide marks, then danda), a comma's, a word's, and at last any character's.
    All but the last need ``least`` bytes, so that no tiny piece is cut off for a strong boundary.
    """
    # (boundary, its greatest length in bytes), strongest first; wide marks are written as their bytes
    ends = [
        (r"\n(?:[ \t\r]{0,2}\n){1,2}(?=\S)", 7), (r"\n(?=[#*\-+0-9])", 1), (r"\n", 1), (r"[.!?][\"')\]]?[ \t\r]", 3),
        (r"(?:\u00E3\u0080\u0082|\u00EF\u00BC[\u0081\u009F]|\u00E0\u00A5\u00A4|\u00D8\u009F)", 3), (r"[,;:][ \t]", 2),
        (r"(?:\u00EF\u00BC\u008C|\u00E3\u0080\u0081)", 3), (r"[ \t]", 1),
    ]
    parts = [".{1,%d}\\z" % limit, *(".{%d,%d}%s" % (least, limit - n, e) for e, n in ends)]
    return "(?s)(?:" + "|".join(parts) + "|.{1,%d}(?![\\u0080-\\u00BF])|.{1,%d})" % (limit, limit)


_RUN = 64


def _starts(lengths: Column) -> Column:
    """The sum of the lengths before each one. Runs of _RUN are summed apart from each other, then the runs before them: the
    longest string Spark holds (2 GiB) has about 2^18 cuts, so this is at most some ten million additions, not their square."""
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / _RUN).cast("int") - 1), lambda r: F.slice(lengths, r * _RUN + 1, _RUN))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, y: a + y)

    def inside(runs: Column, sums: Column) -> Column:
        return F.flatten(F.transform(runs, lambda run, i: F.transform(run, lambda _, j: total(F.slice(sums, F.lit(1), i)) + total(F.slice(run, F.lit(1), j)))))

    return let(F.struct(runs.alias("r"), F.transform(runs, total).alias("s")), lambda x: inside(x["r"], x["s"]))


def pieces_of(body: Column, limit: int, overlap: int) -> Column:
    """array<struct<nr, start_byte, n_bytes, overlap_bytes, text>> of a text; see ``split_pieces``."""
    as_bytes = F.decode(F.encode(body, "UTF-8"), "ISO-8859-1")
    # the first cut looks back on nothing and so may be as long as the limit; all others leave room for the overlap
    first = F.regexp_extract(as_bytes, piece_pattern(limit, limit // 2), 0)

    def rest(head: Column) -> Column:
        core = limit - overlap
        return F.regexp_extract_all(F.substring(as_bytes, F.length(head) + 1, F.length(as_bytes)), F.lit(piece_pattern(core, core // 2)), F.lit(0))

    def piece(cut: Column, starts: Column) -> Column:
        def one(text: Column, i: Column) -> Column:
            # the bytes before, of which up to three continuation bytes are left off at the front
            before = F.when(i == 0, F.lit("")).otherwise(F.regexp_replace(F.right(F.get(cut, F.greatest(i - 1, F.lit(0))), F.lit(overlap)), r"^[\u0080-\u00BF]{1,3}", ""))
            return let(F.struct(before.alias("b"), text.alias("t")), lambda x: F.struct(
                i.alias("nr"), (F.get(starts, i) - F.length(x["b"])).alias("start_byte"), (F.length(x["b"]) + F.length(x["t"])).alias("n_bytes"), F.length(x["b"]).alias("overlap_bytes"),
                F.decode(F.encode(F.concat(x["b"], x["t"]), "ISO-8859-1"), "UTF-8").alias("text"),
            ))

        return F.transform(cut, one)

    cuts = let(first, lambda head: F.concat(F.array(head), rest(head)))
    return let(cuts, lambda c: let(F.struct(c.alias("c"), _starts(F.transform(c, F.length)).alias("s")), lambda x: piece(x["c"], x["s"])))


def split_pieces(docs: DataFrame, text: str = "body", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All columns but the text, with one row per piece: nr, start_byte, n_bytes, overlap_bytes, piece, n_pieces.

    Every piece has at most ``limit`` bytes in UTF-8. Without their overlaps the pieces are the text. A text within the limit is one
    piece; null and empty texts give no row. The first piece has no overlap and may be as long as the limit. The overlap of others is ``overlap`` bytes, up to three fewer where it would start within a character.
    Columns called like the new ones are replaced.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    new = {"nr", "start_byte", "n_bytes", "overlap_bytes", "piece", "n_pieces"}
    keep = [c for c in docs.columns if c != text and c not in new]
    body = F.col(text)
    small = F.array(F.struct(F.lit(0).alias("nr"), F.lit(0).alias("start_byte"), F.octet_length(body).alias("n_bytes"), F.lit(0).alias("overlap_bytes"), body.alias("text")))
    docs = docs.where(F.length(text) > 0).select(*keep, F.when(F.octet_length(body) <= limit, small).otherwise(pieces_of(body, limit, overlap)).alias("_p"))
    docs = docs.select(*keep, F.size("_p").alias("n_pieces"), F.explode("_p").alias("_p"))
    return docs.select(*keep, "n_pieces", "_p.nr", "_p.start_byte", "_p.n_bytes", "_p.overlap_bytes", F.col("_p.text").alias("piece"))


def entry_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lib_id, repository_id, doc_file, body) of every entry that has a doc; repeated entries fold."""
    e = table(spark, sf_dir, "lib_entries").select("lib_id", "repository_id", clean_path(F.col("doc_file")).alias("doc_file")).where("lib_id is not null").distinct()
    return e.join(table(spark, sf_dir, "lib_docs").where("body is not null"), ["repository_id", "doc_file"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose doc had to be cut."""
    return split_pieces(entry_docs(spark, sf_dir)).where("nr = 1").select("lib_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all docs, without their texts: sizes, places and a hash of each."""
    return split_pieces(entry_docs(spark, sf_dir)).select("lib_id", "repository_id", "nr", "n_pieces", "start_byte", "n_bytes", "overlap_bytes", F.xxhash64("piece").alias("hash"))


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all docs with their texts."""
    return split_pieces(entry_docs(spark, sf_dir)).select("lib_id", "repository_id", "nr", "n_pieces", "piece")


def p2_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entry and doc: the bytes the pieces cover without their overlaps, whether all are within the limit, whether every later piece of
    a cut doc has its overlap, and the hash of the pieces put together again without their overlaps."""
    p = split_pieces(entry_docs(spark, sf_dir))
    raw = F.encode("piece", "UTF-8")
    tail = F.substring(raw, F.col("overlap_bytes") + 1, F.col("n_bytes"))
    # a doc is one text, so its pieces are bounded by what one string holds
    return p.groupBy("lib_id", "repository_id", "doc_file").agg(
        F.sum(F.col("n_bytes") - F.col("overlap_bytes")).alias("covered"), (F.max("n_bytes") <= LIMIT).alias("within_limit"),
        F.bool_and((F.col("nr") == 0) | (F.col("overlap_bytes") >= OVERLAP - 3)).alias("overlapped"),
        F.md5(F.aggregate(F.array_sort(F.collect_list(F.struct("nr", tail.alias("b")))), F.lit(b""), lambda a, x: F.concat(a, x["b"]))).alias("joined"),
    )


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_texts": p2_texts, "p2_cover": p2_cover}
_PATH = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(doc_file, E' \\t\\n\\r'), '\\', '/'), '^/srv/checkouts/[^/]+/', ''), '/(?:\\./)+', '/', 'g'), '/{2,}', '/', 'g'), '^(?:\\./|/)+', '')"
ORACLE = {
    "p2_found": f"""
SELECT DISTINCT e.lib_id FROM (SELECT DISTINCT lib_id, repository_id, {_PATH} AS doc_file FROM lib_entries) e
JOIN lib_docs d USING (repository_id, doc_file) WHERE octet_length(encode(d.body)) > {LIMIT}""",
    "p2_cover": f"""
SELECT e.lib_id, repository_id, doc_file, octet_length(encode(d.body)) AS covered, true AS within_limit, true AS overlapped, md5(d.body) AS joined
FROM (SELECT DISTINCT lib_id, repository_id, {_PATH} AS doc_file FROM lib_entries WHERE lib_id IS NOT NULL) e JOIN lib_docs d USING (repository_id, doc_file) WHERE length(d.body) > 0""",
}
