"""Search for many queries at once: full text, vectors, both, and ranking again.

A query set is a table; its terms meet the postings in a join on the term, its vectors all rows in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions import weights as Wt
from ..session import staged
from . import scoring as Sc


def query_terms(queries: DataFrame, qid: str, question: str) -> DataFrame:
    """``qid``, distinct ``term`` and its normalised ``weight`` of each question, cleaned twice, as neighbouring stop words share a space."""
    cleaned = T.clean_query(T.clean_query(F.lower(F.regexp_replace(T.half_width(F.col(question)), r"[ :|\r\n\t,，。？?/`!！&^%()\[\]{}<>]+", " "))))
    terms = queries.select(qid, F.explode(F.array_distinct(T.tokens(cleaned))).alias("term"))
    raw = terms.withColumn("raw", Wt.raw_weight(F.col("term")))
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy(qid))).drop("raw")


def top(scored: DataFrame, qid: str, id_col: str, k: int, score: str = "score") -> DataFrame:
    """The best ``k`` rows of each query, ties by id, with ``rank`` from 1."""
    w = Window.partitionBy(qid).orderBy(F.desc(score), id_col)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _one_row(stats: DataFrame) -> tuple[Column, Column]:
    """Number and average length of the texts, as literals."""
    r = stats.first()
    return F.lit(float(r["n"] or 0)), F.lit(float(r["avgdl"] or 1.0))


def bm25(terms: DataFrame, postings: DataFrame, frequency: DataFrame, stats: DataFrame, qid: str, id_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``qid``, id, ``score`` and ``matched`` terms of every row with a term. ``stats`` is one row, ``frequency`` meets only the queries' terms."""
    n, avgdl = _one_row(stats)
    q = terms.join(frequency, "term").select(qid, "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), avgdl.alias("avgdl"))
    hit = postings.join(q, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    return hit.groupBy(qid, id_col).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def bm25_weights(terms: DataFrame, frequency: DataFrame, n: int, avgdl: float) -> tuple[DataFrame, float]:
    """The terms with their idf as ``w``, for sums of saturated frequencies, and the average length."""
    return terms.join(frequency, "term").withColumn("w", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))), avgdl


def saturated_weights(terms: DataFrame, frequency: DataFrame, n: int, boost: float = 1.0) -> DataFrame:
    """The terms with their part of ``saturated_idf`` as ``w``."""
    return terms.join(frequency, "term").withColumn("w", boost * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) / F.log(1 + (F.lit(float(n)) - 0.5) / 1.5))


def bm25_on_index(terms: DataFrame, postings: DataFrame, frequency: DataFrame, n: int, avgdl: float, qid: str, id_col: str, k1: float = 1.2, b: float = 0.75, most: int = 10_000) -> DataFrame:
    """``bm25`` over written postings in the order of the terms: the terms of up to ``most`` rows of a query set become a filter that
    the scan uses to pass over other row groups; larger sets are joined."""
    rows = terms.select(qid, "term").limit(most + 1).collect()
    if len(rows) > most:
        return bm25(terms, postings, frequency, terms.sparkSession.createDataFrame([(n, avgdl)], "n long, avgdl double"), qid, id_col, k1, b)
    words = sorted({r["term"] for r in rows})
    often = {r["term"]: r["df"] for r in frequency.where(F.col("term").isin(words)).collect()}
    kind = terms.schema[qid].dataType.simpleString()
    known = [(r[qid], r["term"], math.log(1 + (n - often[r["term"]] + 0.5) / (often[r["term"]] + 0.5))) for r in rows if r["term"] in often]
    q = terms.sparkSession.createDataFrame(known, f"`{qid}` {kind}, term string, idf double")
    hit = postings.where(F.col("term").isin(words)).join(F.broadcast(q), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / avgdl))
    return hit.groupBy(qid, id_col).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def saturated_idf(terms: DataFrame, postings: DataFrame, frequency: DataFrame, stats: DataFrame, qid: str, id_col: str, boost: float = 1.0) -> DataFrame:
    """The scripted similarity of token fields: idf against that of the rarest term, with a term frequency of one at most."""
    n, _ = _one_row(stats)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) / F.log(1 + (n - 0.5) / 1.5)
    q = terms.join(frequency, "term").select(qid, "term", (idf * boost).alias("s"))
    return postings.select(id_col, "term").join(q, "term").groupBy(qid, id_col).agg(F.sum("s").alias("score"), F.count("*").alias("matched"))


def best_fields(scores: dict[str, tuple[DataFrame, float]], qid: str, id_col: str) -> DataFrame:
    """The greatest of the boosted scores of several fields."""
    out = None
    for name, (df, boost) in scores.items():
        part = df.select(qid, id_col, (F.col("score") * boost).alias("score"), F.lit(name).alias("field"), "matched")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(qid, id_col).agg(F.max("score").alias("score"), F.max_by("field", F.struct("score", "field")).alias("field"), F.max("matched").alias("matched"))


def min_should_match(scored: DataFrame, terms: DataFrame, qid: str, share: float = 0.6) -> DataFrame:
    """Hits with at least ``share`` of the query's terms, rounded down."""
    n = terms.groupBy(qid).agg(F.count("*").alias("terms"))
    return scored.join(n, qid).where(F.col("matched") >= F.floor(F.col("terms") * share)).drop("terms")


def coverage(terms: DataFrame, postings: DataFrame, qid: str, id_col: str) -> DataFrame:
    """The share of a query's weight that the tokens of a row cover."""
    return postings.select(id_col, "term").join(terms, "term").groupBy(qid, id_col).agg((F.sum("weight") + F.lit(1e-9)).alias("s")).select(qid, id_col, (F.col("s") / (1 + 1e-9)).alias("score"))


def knn(queries: DataFrame, rows: DataFrame, qid: str, id_col: str, vector: str, k: int = 10, least: float | None = None, block: int = 4096, group: str | None = None) -> DataFrame:
    """The nearest ``k`` rows by cosine of every query, exactly.

    Queries go in blocks of ``block`` to all rows; a task keeps its best ``k`` for each query, and a second
    ranking takes the best of those, so no other pair of query and row ever leaves its task. Null, zero and vectors of
    another length are left out. ``group``: the nearest ``k`` within each value of it; ``least``: the least cosine."""
    kind = rows.schema[id_col].dataType.simpleString()
    some = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("i"), (F.col(group).cast("string") if group else F.lit("")).alias("g"), F.col(vector).cast("array<double>").alias("v"))

    def against(qs: list[tuple]) -> DataFrame:
        names = np.array([q for q, _ in qs], np.int64)
        x = np.array([v for _, v in qs], float).reshape(len(qs), -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))
        x, names = x[np.abs(x).sum(axis=1) > 0], names[np.abs(x).sum(axis=1) > 0]

        def rows_of(best: dict) -> pd.DataFrame:
            parts = [] if not len(names) else [pd.DataFrame({"q": np.repeat(names, s.shape[1]), "i": ids.ravel(), "g": g, "score": s.ravel()}) for g, (s, ids) in best.items()]
            out = pd.concat(parts) if parts else pd.DataFrame({"q": np.zeros(0, np.int64), "i": pd.Series([], dtype=object), "g": pd.Series([], dtype=object), "score": np.zeros(0)})
            return out[out["score"] >= (least if least is not None else -2.0)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # the best k of the task so far, by value of the group; a task gives k rows for a query (and group) at most
            best: dict = {}
            for pdf in batches:
                pdf = pdf[pdf["v"].map(lambda v: len(v) == x.shape[1])] if len(names) else pdf.iloc[:0]
                for g, part in pdf.groupby("g", sort=False, dropna=False):
                    y = np.stack(part["v"].to_numpy()).astype(float)
                    size = np.linalg.norm(y, axis=1)
                    y, ids = y[size > 0] / size[size > 0, None], part["i"].to_numpy()[size > 0]
                    for a in range(0, len(ids), 4096):
                        s = x @ y[a : a + 4096].T
                        own = np.broadcast_to(ids[a : a + 4096], s.shape)
                        if g in best:
                            s, own = np.concatenate([best[g][0], s], axis=1), np.concatenate([best[g][1], own], axis=1)
                        order = np.lexsort((own, -s), axis=1)[:, :k]
                        best[g] = (np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1))
                if len(best) > 1000:
                    yield rows_of(best)
                    best = {}
            yield rows_of(best)

        return some.mapInPandas(run, f"q long, i {kind}, g string, score double")

    found, qs, length = None, [], None
    for r in queries.where(F.col(vector).isNotNull()).select(F.col(qid).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).toLocalIterator():
        length = length or len(r["v"])
        if len(r["v"]) == length and all(x is not None for x in r["v"]):
            qs.append((r["q"], list(r["v"])))
        if len(qs) == block:
            found, qs = (against(qs) if found is None else found.unionByName(against(qs))), []
    if qs or found is None:
        found = against(qs or [(-1, [0.0])]) if found is None else found.unionByName(against(qs))
    w = Window.partitionBy("q", "g").orderBy(F.desc("score"), "i")
    best = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    cols = [F.col("q").alias(qid), F.col("i").alias(id_col), "score", "rank"]
    return best.select(*cols, *([F.col("g").alias(group)] if group else []))


def lsh_index(rows: DataFrame, id_col: str, vector: str, tables: int = 16, bits: int = 6, seed: int = 11, dimensions: int = 64) -> DataFrame:
    """Every row with its bucket in each of ``tables`` tables of random hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dimensions))

    @F.pandas_udf("array<long>")
    def buckets(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(a, float) if a is not None and len(a) == dimensions else np.zeros(dimensions) for a in v]) if len(v) else np.zeros((0, dimensions))
        signs = np.einsum("nd,tbd->ntb", x, planes) > 0
        return pd.Series(list((signs << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)))

    return rows.where(F.size(vector) == dimensions).select(id_col, vector, F.explode(buckets(F.col(vector))).alias("bucket"))


def knn_lsh(queries: DataFrame, rows: DataFrame, qid: str, id_col: str, vector: str, k: int = 10, **index) -> DataFrame:
    """The nearest rows among those that share a bucket with the query; the number of tables sets the recall."""
    a = lsh_index(queries.select(F.col(qid).alias("_q"), vector), "_q", vector, **index).withColumnRenamed(vector, "_v")
    b = lsh_index(rows, id_col, vector, **index)
    pairs = a.join(b, "bucket").groupBy("_q", id_col).agg(V.cosine(F.first("_v"), F.first(vector)).alias("score"))
    return top(pairs.withColumnRenamed("_q", qid), qid, id_col, k)


def weighted_sum(text: DataFrame, dense: DataFrame, qid: str, id_col: str, text_weight: float = 0.05, dense_weight: float = 0.95, alone: DataFrame | None = None) -> DataFrame:
    """The fused score of two sets of candidates; a missing one counts 0. ``alone``: the dense candidates that aren't among those of
    text, where that is known; the others then need no shuffle to meet a small ``dense``."""
    left = text.select(qid, id_col, F.col("score").alias("t"))
    both = left.join(dense.select(qid, id_col, F.col("score").alias("d")), [qid, id_col], "left" if alone is not None else "full")
    if alone is not None:
        both = both.unionByName(alone.select(qid, id_col, F.lit(None).cast("double").alias("t"), F.col("score").alias("d")))
    return both.select(qid, id_col, (text_weight * F.coalesce("t", F.lit(0.0)) + dense_weight * F.coalesce("d", F.lit(0.0))).alias("score"))


def hybrid(candidates: DataFrame, qid: str, token_weight: float = 0.3, vector_weight: float = 0.7) -> DataFrame:
    """``score`` of candidates with ``cos`` and ``tok``; the tokens alone count where no candidate of the query has a cosine."""
    none = F.sum(F.coalesce("cos", F.lit(0.0))).over(Window.partitionBy(qid)) == 0
    return candidates.withColumn("score", F.when(none, F.col("tok")).otherwise(vector_weight * F.coalesce("cos", F.lit(0.0)) + token_weight * F.col("tok")))


def token_bag(content: Column, title: Column, important: Column, question: Column) -> Column:
    """The tokens that ranking looks at; how often they occur doesn't matter."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.array_union(F.coalesce(content, empty), F.coalesce(title, empty)), F.array_union(F.coalesce(important, empty), F.coalesce(question, empty)))


def keyword_matches(terms: DataFrame, rows: DataFrame, qid: str, id_col: str, keywords: str, boost: float = 30.0) -> DataFrame:
    """Boolean similarity of a keyword field: ``boost`` for each of the query's terms among the tokens of the row's keywords, however
    often it is there and however rare it is."""
    words = rows.select(id_col, F.explode(F.array_distinct(F.flatten(F.transform(keywords, lambda x: T.tokens(F.coalesce(x, F.lit(""))))))).alias("term"))
    return words.join(terms, "term").groupBy(qid, id_col).agg((F.count("*") * boost).alias("score"))


def above(scored: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Hits of at least a score: what a descending list has before the first one under it."""
    return scored.where(F.col(score) >= least)


def overlapping_terms(sets: DataFrame, queries: DataFrame, qid: str, id_col: str, terms: str, least: float = 0.3) -> DataFrame:
    """``qid``, id and ``tok`` (the share of the query's distinct terms that a row has) of the pairs from ``least`` on.

    Tasks count the terms and give the pairs that share enough; no term brings together rows of a join."""
    of = staged(queries.select(F.col(id_col).cast("long").alias("q"), F.size(terms).alias("n"), F.explode(terms).alias("term")), "asked")
    words = Sc.vocabulary(of)
    bound = of.withColumn("least", F.ceil(F.lit(least) * F.col("n") - 1e-9))
    pairs = Sc.at_least(Sc.coded(sets, id_col, F.col(terms), words), Sc.blocks(bound, "q", words, None, "least"), len(words), "q", id_col)
    tok = pairs.withColumn("tok", F.col("score") / F.col("terms"))
    return tok.select(F.col("q").cast(queries.schema[id_col].dataType).alias(qid), id_col, "tok").where(F.col("tok") >= least)


def rank_feature(tags: Column, pagerank: Column, query_tags: dict[str, float]) -> Column:
    """Ten times the cosine of tags, and the page rank."""
    page = F.coalesce(pagerank, F.lit(0.0))
    return F.lit(10.0) * V.map_cosine(query_tags, tags) + page if query_tags else page


def min_max(score: Column, partition: str) -> Column:
    """A score between 0 and 1 within its query; all 0 if all are equal."""
    w = Window.partitionBy(partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(0.0)


def page(ranked: DataFrame, number: int, size: int) -> DataFrame:
    return ranked.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))


def window_size(page_number: int, size: int) -> int:
    """Candidates that are ranked again: three pages, 128 at least."""
    return max(3 * size, 128) if page_number <= 3 else size


def doc_aggs(hits: DataFrame, qid: str, name: str, doc: str) -> DataFrame:
    """Files of a page of hits, with how many each has."""
    return hits.groupBy(qid, name).agg(F.min(doc).alias("doc_id"), F.count("*").alias("count"))


def with_fallback(hits: DataFrame, wider: DataFrame, qid: str) -> DataFrame:
    """The hits, and for the queries without one those of a wider search."""
    return hits.unionByName(wider.join(hits.select(qid).distinct(), qid, "left_anti"))
