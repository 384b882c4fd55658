"""Weights of query terms: idf of frequency and document frequency, by kind of term.

Without dictionaries the weight has a closed form; dictionaries are small maps given by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(s: Column, n: float) -> Column:
    return F.log10(10 + (n - s + 0.5) / (s + 0.5))


def raw_weight(t: Column, frequency: Column | None = None, documents: Column | None = None, entity: Column | None = None) -> Column:
    """The weight before normalisation; the arguments are dictionary look-ups of the term, null where it is unknown."""
    none = F.lit(None).cast("double")
    frequency, documents, entity = (none if x is None else x for x in (frequency, documents, entity))
    latin = t.rlike(r"^[a-z. -]+$")
    f = F.when(t.rlike(r"^[0-9. -]{2,}$"), 3.0).when(frequency.isNull() & latin, 300.0).otherwise(F.greatest(F.coalesce(frequency, F.lit(0.0)), F.lit(10.0)))
    d = F.when(t.rlike(r"^[0-9. -]{2,}$"), 5.0).when(documents.isNotNull(), documents + 3).when(latin, 300.0).otherwise(3.0)
    e = F.when(t.rlike(r"^[0-9,.]{2,}$"), 2.0).when(t.rlike(r"^[a-z]{1,2}$"), 0.01).otherwise(F.coalesce(entity, F.lit(1.0)))
    return (0.3 * idf(f, 1e7) + 0.7 * idf(d, 1e9)) * e


def coverage(query: Column, weights: Column, doc: Column) -> Column:
    """The share of a query's weight that a document's tokens cover; only membership counts."""
    got = F.aggregate(F.zip_with(query, weights, lambda t, w: F.when(F.array_contains(doc, t), w).otherwise(0.0)), F.lit(1e-9), lambda s, x: s + x)
    return got / F.aggregate(weights, F.lit(1e-9), lambda s, x: s + x)
