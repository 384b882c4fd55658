"""Ranking by a pluggable model, keywords of paragraphs, and tags."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import min_max


class Scorer(Protocol):
    """``score`` gives a number for each pair of question and text."""

    def score(self, questions: list[str], texts: list[str]) -> np.ndarray: ...


class OverlapScorer:
    """A deterministic scorer without a model: the share of the question's words in the text."""

    def score(self, questions: list[str], texts: list[str]) -> np.ndarray:
        out = []
        for q, t in zip(questions, texts, strict=True):
            words = set(q.lower().split())
            out.append(len(words & set(t.lower().split())) / max(1, len(words)))
        return np.array(out, float)


def model_scores(question: Column, text: Column, scorer: Scorer) -> Column:
    """The model's score of each row; the model is loaded once per worker. Nulls count as empty texts."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series(np.asarray(scorer.score(q.fillna("").tolist(), t.fillna("").tolist()), float))

    return run(question, text)


def rerank_by_model(candidates: DataFrame, qid: str, question: str, text: str, scorer: Scorer, token_weight: float = 0.3, vector_weight: float = 0.7, scaled: bool = True) -> DataFrame:
    """``score`` from the tokens' similarity (``tok``), the rank features (``rank_fea``) and the model; its scores are
    scaled between 0 and 1 within a query."""
    df = candidates.withColumn("_m", model_scores(F.col(question), F.col(text), scorer))
    model = min_max(F.col("_m"), qid) if scaled else F.col("_m")
    return df.withColumn("score", token_weight * (F.col("tok") + F.coalesce("rank_fea", F.lit(0.0))) + vector_weight * model).drop("_m")


def top_terms(postings: DataFrame, weights: DataFrame, id_col: str, k: int = 30) -> DataFrame:
    """The ``k`` terms of each text of the greatest weight, and how many of them another text must have (a tenth, three at most)."""
    w = Window.partitionBy(id_col).orderBy(F.desc("weight"), "term")
    best = postings.join(weights, "term").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.groupBy(id_col).agg(F.array_sort(F.collect_list("term")).alias("terms"), F.count("*").alias("n")).withColumn("must", F.least(F.lit(3), F.floor(F.col("n") / 10)).cast("int")).drop("n")


def tag_portions(tagged: DataFrame, tag: str, smooth: float = 1000.0) -> DataFrame:
    """The smoothed portion of each tag: (count + 1) / (all + S)."""
    counts = tagged.groupBy(tag).agg(F.count("*").alias("n"))
    return counts.withColumn("portion", (F.col("n") + 1) / (F.sum("n").over(Window.partitionBy(F.lit(1))) + smooth)).drop("n")


def tag_scores(hits: DataFrame, portions: DataFrame, key: str, tag: str, k: int = 3, smooth: float = 1000.0) -> DataFrame:
    """The ``k`` tags of each query (or text) that its hits have beyond the prior: a tenth of (c + 1) / (n + S) / prior, rounded."""
    total = hits.groupBy(key).agg(F.count("*").alias("all"))
    counts = hits.groupBy(key, tag).agg(F.count("*").alias("c")).join(total, key).join(portions, tag)
    scored = counts.withColumn("score", F.round(0.1 * (F.col("c") + 1) / (F.col("all") + smooth) / F.greatest(F.col("portion"), F.lit(1e-6)), 6))
    w = Window.partitionBy(key).orderBy(F.desc("score"), tag)
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(key, tag, "score")
