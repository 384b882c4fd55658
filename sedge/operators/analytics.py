"""Quality and statistics of chunks and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def chunk_stats(df: DataFrame, text: str, *group: str) -> DataFrame:
    """Counts, tokens and characters; averages are over the texts that aren't empty."""
    full = F.col(text).isNotNull() & (F.col(text) != "")
    n = F.when(full, T.token_count(F.col(text)))
    chars = F.when(full, F.length(text).cast("long"))
    return df.groupBy(*group).agg(
        F.count("*").alias("total_chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"), F.avg(n).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.coalesce(F.sum(chars), F.lit(0)).alias("total_chars")
    )


def chunk_quality(df: DataFrame, text: str, *group: str) -> DataFrame:
    """Lengths with their population variance, shares of short, long and empty chunks, and a score of 100 less penalties."""
    length = F.when(F.col(text) != "", F.length(text))
    q = df.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(length).alias("avg_length"), F.var_pop(length).alias("var_length"), F.count_if(length < 50).alias("short"), F.count_if(length > 2000).alias("long"),
        F.count_if(F.col(text).isNull() | (F.col(text) == "")).alias("empty"),
    )
    score = 100 - 30 * F.col("short") / F.col("n") - 20 * F.col("long") / F.col("n") - F.coalesce(50 * F.col("var_length") / F.nullif(F.col("avg_length") * F.col("avg_length"), F.lit(0.0)), F.lit(0.0))
    return q.withColumn("score", F.greatest(F.lit(0.0), score))


def optimal_size(words: Column, chunks: Column) -> Column:
    return F.greatest(F.lit(128), F.least(F.lit(512), F.floor(words / F.greatest(chunks, F.lit(1))))).cast("long")


def suggestions(quality: DataFrame) -> DataFrame:
    """What the figures of ``chunk_quality`` call for."""
    rules = [
        (F.col("score") < 60, "quality is low"), (F.col("short") / F.col("n") > 0.2, "many short chunks"), (F.col("long") / F.col("n") > 0.1, "many long chunks"),
        (F.col("var_length") > 0.5 * F.col("avg_length") * F.col("avg_length"), "lengths vary"), (F.col("empty") > 0, "empty chunks"),
    ]
    return quality.withColumn("suggestions", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules])), "; "))


def greatest_line(df: DataFrame, line: str, *group: str, least: str = "1970-01-01 00:00:00") -> DataFrame:
    """The greatest of the lines (times as text, say) that aren't ``nan``, at least ``least``."""
    return df.groupBy(*group).agg(F.greatest(F.coalesce(F.max(F.when(F.col(line) != "nan", F.col(line))), F.lit(least)), F.lit(least)).alias("greatest"))


def norm_stats(df: DataFrame, vector: str) -> DataFrame:
    n = V.norm(F.col(vector))
    return df.agg(F.count("*").alias("n"), F.avg(n).alias("mean_norm"), F.stddev_pop(n).alias("std_norm"), F.min(n).alias("min_norm"), F.max(n).alias("max_norm"))


def pair_stats(df: DataFrame, id_col: str, vector: str, most: int = 100) -> DataFrame:
    """Cosines between ``most`` rows, those of the least hashed ids (a report on a sample of fixed size)."""
    some = df.select(id_col, vector).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(most)
    a, b = some.toDF("i", "x"), some.toDF("j", "y")
    c = V.cosine(F.col("x"), F.col("y"))
    return a.crossJoin(F.broadcast(b)).where("i <> j").agg(F.count("*").alias("pairs"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def kmeans(df: DataFrame, id_col: str, vector: str, k: int = 5, seed: int = 42) -> tuple[DataFrame, float]:
    """Clusters, and their silhouette (by squared Euclidean distance)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    out = KMeans(k=k, seed=seed).fit(rows).transform(rows)
    return out.select(id_col, F.col("prediction").alias("cluster")), ClusteringEvaluator().evaluate(out)


def store_report(df: DataFrame, ok: Column, seconds: float) -> DataFrame:
    """Success rate and speed of a write, with advice."""
    r = df.agg(F.count("*").alias("total"), F.count_if(ok).alias("stored"))
    r = r.withColumn("success_rate", F.col("stored") / F.nullif(F.col("total"), F.lit(0))).withColumn("per_second", F.col("stored") / F.lit(max(seconds, 1e-9)))
    advice = F.array_compact(F.array(F.when(F.col("success_rate") < 0.95, F.lit("check failed chunks")), F.when(F.col("per_second") < 10, F.lit("storage is slow"))))
    return r.withColumn("advice", F.array_join(advice, "; "))
