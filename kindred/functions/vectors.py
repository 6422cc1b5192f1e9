"""Dot products and late interaction over arrays of numbers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """Scaled to length 1; zeros stay."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def slices(a: Column, width: int, count: int) -> Column:
    """A vector as `count` token vectors of `width` numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(a, i * width + 1, F.lit(width)))


def maxsim(query: Column, doc: Column) -> Column:
    """Mean over the query's token vectors of the best dot product with any of the document's; 0 for an empty side."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.when((F.size(query) == 0) | (F.size(doc) == 0), 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query))


def calibrated(score: Column, bias: float, tau: float) -> Column:
    """Sigmoid of the score shifted by bias over a temperature of at least a hundredth."""
    return 1 / (1 + F.exp(-(score - bias) / max(tau, 0.01)))
