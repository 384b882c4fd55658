"""Word definitions and small helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: one character U+4E00-U+9FFF, or a maximal run of letters and digits without underscore.
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
#: The same for the JVM.
WORD_JVM = r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"


def words_of(text: str | None) -> list[str]:
    """The words of a text, lower-cased; none of a null."""
    return WORD.findall(text.lower()) if text else []


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def chunk_config(source_file: DataFrame, chunking_config: DataFrame, *fields: str) -> DataFrame:
    """``doc_id`` with the named fields of its file's config; files without a config give no row.

    Repeated rows collapse; of several different rows of one id the latest, then the greatest, counts."""
    files = (
        source_file.where("doc_id is not null and config_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.struct("uploaded_at", "config_id")).alias("m"))
        .select("doc_id", F.col("m.config_id").alias("config_id"))
    )
    configs = (
        chunking_config.where("config_id is not null")
        .groupBy("config_id")
        .agg(F.max(F.struct("updated_at", *fields)).alias("m"))
        .select("config_id", *[F.col(f"m.{f}").alias(f) for f in fields])
    )
    return files.join(configs, "config_id").select("doc_id", *fields)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with at most ``most`` units together (a larger row stands alone)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def non_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bounded_sample(rows: DataFrame, most: int, *keys: str, by: str | None = None) -> DataFrame:
    """At most ``most`` rows, those of the least hash of ``keys``; whatever the input's size, about twice as many rows at the
    most are compared for it. ``by``: about as many of each of the 50 most frequent values of a column."""
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    if by is None:
        n = rows.count()
        if n > most:
            rows = rows.where(h < int((1 << 40) * min(1.0, 1.5 * most / n)))
        return rows.orderBy(h, *keys).limit(most)
    counts = rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(50).collect()
    quota = 1.3 * most / max(1, len(counts))
    limit = F.lit(0).cast("long")
    for r in counts:
        limit = F.when(F.col(by).eqNullSafe(F.lit(r[by])), int((1 << 40) * min(1.0, quota / r["n"]))).otherwise(limit)
    return rows.where(h < limit).orderBy(h, *keys).limit(most)
