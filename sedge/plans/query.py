"""Search requests as plain values, and the planner that turns one into a DataFrame.

Analysis of the question and the choice of a plan happen on the driver; everything else is one Spark plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import index as I
from ..operators import retrieval as R
from ..session import staged


@dataclass(frozen=True)
class MatchText:
    """A question against token fields; a hit has ``min_match`` of its terms at least."""

    question: str
    fields: tuple[str, ...] = ("content_with_weight",)
    topn: int = 10
    min_match: float = 0.6


@dataclass(frozen=True)
class MatchDense:
    """A vector against a column, by cosine."""

    column: str
    vector: tuple[float, ...]
    topn: int = 10
    similarity: float = 0.0

    def __post_init__(self):
        if any(isinstance(x, list | tuple) for x in self.vector):
            raise ValueError("a query vector has one dimension")


@dataclass(frozen=True)
class MatchSparse:
    """Weights by index against a map column, by dot product."""

    column: str
    indices: tuple[int, ...]
    values: tuple[float, ...]
    topn: int = 10

    def __post_init__(self):
        if len(self.indices) != len(self.values):
            raise ValueError("as many indices as values")


@dataclass(frozen=True)
class Fusion:
    """How text and vector go together: the text as a filter, or both scores as a weighted sum."""

    mode: Literal["filter", "sum"] = "filter"
    text_weight: float = 0.05
    dense_weight: float = 0.95


@dataclass(frozen=True)
class OrderBy:
    """Sort keys; an array counts by its average, nulls come last."""

    keys: tuple[tuple[str, bool], ...] = ()

    def asc(self, name: str) -> OrderBy:
        return OrderBy((*self.keys, (name, True)))

    def desc(self, name: str) -> OrderBy:
        return OrderBy((*self.keys, (name, False)))

    def columns(self, df: DataFrame) -> list:
        def value(n):
            c = F.col(n)
            return F.aggregate(c.cast("array<double>"), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(c), F.lit(0)) if df.schema[n].dataType.typeName() == "array" else c

        return [value(n).asc_nulls_last() if up else value(n).desc_nulls_last() for n, up in self.keys if n in df.columns]


@dataclass(frozen=True)
class Request:
    text: MatchText | None = None
    dense: MatchDense | None = None
    sparse: MatchSparse | None = None
    fusion: Fusion = field(default_factory=Fusion)
    filters: dict = field(default_factory=dict)
    order: OrderBy = field(default_factory=OrderBy)
    fields: tuple[str, ...] = ()
    page: int = 1
    size: int = 10
    highlight: bool = False


def _terms(spark, question: str) -> DataFrame:
    return R.query_terms(spark.createDataFrame([(0, question)], "q int, question string"), "q", "question")


def plan(table: DataFrame, request: Request, id_col: str = "id") -> DataFrame:
    """Hits with ``score``, the requested page of them; without text and vector the rows in the asked order.

    A vector column that the table lacks leaves the text alone; an empty question without a vector gives no hit."""
    rows = table.where(I.conditions({"available_int": 1, **request.filters} if "available_int" in table.columns else request.filters))
    dense = request.dense if request.dense and request.dense.column in table.columns else None
    keep = [c for c in (request.fields or table.columns) if c in table.columns and c != id_col]
    if request.text is None and dense is None and request.sparse is None:
        out = rows.orderBy(*request.order.columns(rows), id_col).select(id_col, *keep)
        return out.offset((request.page - 1) * request.size).limit(request.size)
    text = keywords = None
    if request.text is not None:
        q = _terms(table.sparkSession, request.text.question)
        keywords = q.agg(F.collect_list("term").alias("_k"))
        scores = {}
        for name in request.text.fields:
            p = I.postings(rows, id_col, name)
            stats = p.groupBy(id_col).agg(F.first("length").alias("l")).agg(F.count("*").alias("n"), F.avg("l").alias("avgdl"))
            scores[name] = (R.bm25(q, p, I.document_frequency(p), stats, "q", id_col), I.FIELD_BOOSTS.get(name, 1.0))
        text = R.min_should_match(R.best_fields(scores, "q", id_col), q, "q", request.text.min_match).select(id_col, "score")
    if dense is not None:
        vector = F.array(*[F.lit(float(x)) for x in dense.vector])
        near = rows.join(text.select(id_col), id_col, "left_semi") if text is not None and request.fusion.mode == "filter" else rows
        near = near.select(id_col, V.cosine(F.col(dense.column), vector).alias("score")).where((F.col("score") >= dense.similarity)).orderBy(F.desc("score"), id_col).limit(dense.topn)
        if text is not None and request.fusion.mode == "sum":
            one = lambda d: d.withColumn("q", F.lit(0))
            hits = R.weighted_sum(one(text), one(near), "q", id_col, request.fusion.text_weight, request.fusion.dense_weight).drop("q")
        else:
            hits = near
    elif text is not None:
        hits = text
    else:
        m = F.col(request.sparse.column)
        hits = rows.select(id_col, sum((F.coalesce(F.try_element_at(m, F.lit(i)), F.lit(0.0)) * v for i, v in zip(request.sparse.indices, request.sparse.values, strict=True)), F.lit(0.0)).alias("score")).where("score > 0")
    best = hits.orderBy(F.desc("score"), id_col).offset((request.page - 1) * request.size).limit(request.size)
    out = best.join(rows.select(id_col, *keep), id_col)
    if request.highlight and keywords is not None and "content_with_weight" in keep:
        out = out.crossJoin(F.broadcast(keywords)).withColumn("highlight", T.highlight(F.col("content_with_weight"), F.col("_k"))).drop("_k")
    return out.orderBy(F.desc("score"), id_col)


def search(table: DataFrame, request: Request, id_col: str = "id") -> DataFrame:
    """Like ``plan``, with a wider second try if there is no hit: a tenth of the terms, no restriction to files, cosines from 0.17."""
    from dataclasses import replace

    hits = plan(table, request, id_col)
    if request.text is None and request.dense is None:
        return hits
    hits = staged(hits, "hits")  # a page of hits; else the plan would run once more
    if not hits.isEmpty():
        return hits.orderBy(F.desc("score"), id_col)
    wider = replace(
        request,
        text=request.text and replace(request.text, min_match=0.1),
        dense=request.dense and replace(request.dense, similarity=0.17),
        filters={k: v for k, v in request.filters.items() if k not in ("doc_ids", "doc_id")},
    )
    return plan(table, wider, id_col)
