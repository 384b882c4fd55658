"""Cutting oversized texts into numbered pieces, with SQL expressions only.

A text becomes an array of units (a token with the white space after it) and a string with one letter
per unit, telling how strong a boundary follows it. A regular expression with bounded quantifiers,
its alternatives ordered by strength, then consumes this string; the lengths of its matches are the
cuts, and a piece begins ``overlap`` units before the cut.

Defined results: a null, empty or blank text and a text within the limit give no piece; no or a
non-positive limit means no limit; a null or negative overlap is 0, one of the limit or more is the
limit less one; a null or empty delimiter leaves the natural boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunk_config

_SPACE = r" \t\n\r\x{a0}\x{3000}"
_TOKEN = rf"(?:[\x{{4e00}}-\x{{9fff}}]|[^{_SPACE}\x{{4e00}}-\x{{9fff}}]+)"
_UNIT = rf"[{_SPACE}]*{_TOKEN}[{_SPACE}]*"


def token_count(text: Column) -> Column:
    """Tokens of a text: single characters U+4E00-U+9FFF, and runs of others without white space."""
    return F.regexp_count(text, F.lit(_TOKEN))


def delimiter_pattern(delimiter: Column) -> Column:
    """A pattern for the end of a unit after which ``delimiter`` allows a cut; null without a delimiter.

    Notation: each character is a delimiter, groups in back-ticks are delimiters of several characters, and
    \\n, \\t, \\r may be written as escapes."""
    plain = F.replace(F.replace(F.replace(delimiter, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r"))
    groups = F.regexp_extract_all(plain, F.lit("`([^`]+)`"), 1)
    single = F.filter(F.split(F.regexp_replace(plain, "`[^`]+`", ""), ""), lambda x: (x != "") & (x != "`"))
    quoted = F.transform(F.array_distinct(F.concat(groups, single)), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E")))
    return F.when(F.size(quoted) > 0, F.concat(F.lit("(?:"), F.array_join(quoted, "|"), F.lit(f")[{_SPACE}]*$")))


def split_texts(rows: DataFrame, text: str = "text", limit: str = "limit", overlap: str = "overlap", delimiter: str = "delimiter") -> DataFrame:
    """Rows with more tokens than ``limit``, one row per piece: all other columns, ``n_tokens`` of the text,
    ``piece_no`` from 0, ``piece`` and ``piece_tokens``."""
    keep = [c for c in rows.columns if c not in (text, limit, overlap, delimiter)]
    most = F.col("_limit")
    df = rows.select(*keep, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("_over"), delimiter_pattern(F.col(delimiter)).alias("_delim"))
    df = df.where(most > 0).withColumn("n_tokens", token_count(F.col("_text"))).where(F.col("n_tokens") > most)
    df = df.withColumn("_over", F.greatest(F.lit(0), F.least("_over", most - 1)))
    df = df.withColumn("_units", F.regexp_extract_all("_text", F.lit(_UNIT), 0))
    strength = lambda u: (
        F.when(F.coalesce(F.regexp_like(u, F.col("_delim")), F.lit(False)), "d")
        .when(u.rlike(r"\n[ \t\r]*\n"), "p")
        .when(u.rlike(rf"[.!?;…。！？；][\"'”’»)）]*[{_SPACE}]*$") | u.rlike(r"\n"), "s")
        .when(u.rlike(rf"[,:，、：][{_SPACE}]*$"), "c")
        .otherwise("w")
    )
    df = df.withColumn("_marks", F.array_join(F.transform("_units", strength), ""))
    step = most - F.col("_over")
    many, any_ = F.concat(F.lit(".{"), F.ceil(step / 2).cast("string"), F.lit(","), step.cast("string"), F.lit("}")), F.concat(F.lit(".{1,"), step.cast("string"), F.lit("}"))
    alternatives = [F.concat(any_, F.lit("$"))] + [F.concat(x, F.lit(f"(?<={m})")) for x in (many, any_) for m in ("d", "p", "s", "c")] + [any_]
    df = df.withColumn("_cuts", F.transform(F.regexp_extract_all("_marks", F.concat_ws("|", *alternatives), F.lit(0)), lambda s: F.length(s)))
    ends = F.aggregate("_cuts", F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    df = df.select(*keep, "n_tokens", "_units", "_over", F.posexplode(F.arrays_zip(ends.alias("end"), F.col("_cuts").alias("size"))).alias("piece_no", "_p"))
    begin = F.greatest(F.lit(0), F.col("_p.end") - F.col("_p.size") - F.col("_over"))
    count = F.col("_p.end") - begin
    return df.select(*keep, "n_tokens", "piece_no", F.array_join(F.slice("_units", begin + 1, count), "").alias("piece"), count.alias("piece_tokens"))


def split_chunks(chunk: DataFrame, source_file: DataFrame, chunking_config: DataFrame) -> DataFrame:
    """The pieces of every chunk above the ``chunk_token_num`` of its file's config.

    Only chunks above the smallest limit in use travel to the join with the configs."""
    config = chunk_config(source_file, chunking_config, "chunk_token_num", "overlap_token_num", "delimiter").where("chunk_token_num > 0")
    least = chunking_config.where("chunk_token_num > 0").agg(F.min("chunk_token_num")).first()[0]
    some = chunk.select("id", "doc_id", "content_with_weight").where("id is not null and content_with_weight is not null")
    some = some.where(token_count(F.col("content_with_weight")) > F.lit(least)) if least is not None else some.limit(0)
    rows = some.join(config, "doc_id").select("id", "doc_id", "content_with_weight", "chunk_token_num", "overlap_token_num", "delimiter").dropDuplicates(["id"])
    return split_texts(rows, "content_with_weight", "chunk_token_num", "overlap_token_num", "delimiter")
