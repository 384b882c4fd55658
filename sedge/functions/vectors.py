"""Vector expressions on arrays; doubles throughout, null for a zero vector or null input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def blend(title: Column, content: Column, weight: float = 0.1) -> Column:
    """A title's vector and a content's, weighted."""
    return F.zip_with(title.cast("array<double>"), content.cast("array<double>"), lambda t, c: t * weight + c * (1 - weight))


def scaled(a: Column) -> Column:
    """A vector of length 1."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a.cast("array<double>"), lambda x: x / n)


def map_cosine(q: dict[str, float], m: Column, without: str = "pagerank_fea") -> Column:
    """Cosine of query tags with a map of tags: the query's norm without ``without``, the map's over all tags; 0 if undefined."""
    top, size = F.lit(0.0), sum(v * v for k, v in q.items() if k != without) ** 0.5
    for k, v in q.items():
        if k != without:
            top = top + F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0.0)) * v
    own = F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(top / F.nullif(own * size, F.lit(0.0)), F.lit(0.0))
