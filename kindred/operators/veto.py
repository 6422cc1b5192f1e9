"""Hard contradictions of addresses and countries, as boolean expressions that are never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def _apart(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def numeric_conflict(a: Column, b: Column) -> Column:
    """Both have street numbers other than 0 and share none."""
    x, y = (F.filter(text.street_numbers(c), lambda n: n != "0") for c in (a, b))
    return _apart(x, y)


def pin_conflict(a: Column, b: Column) -> Column:
    return _apart(text.pins(a), text.pins(b))


def geographic_conflict(country_a: Column, country_b: Column, a: Column, b: Column) -> Column:
    """Countries given and different; or, if either is US or the first is not given, states given and different."""
    x, y = text.country(country_a), text.country(country_b)
    s, t = text.state(a, district=False), text.state(b, district=False)
    return ((x != "") & (y != "") & (x != y)) | (((x == "US") | (y == "US") | (x == "")) & F.coalesce(s != t, F.lit(False)))


def veto(a: Column, b: Column, country_a: Column, country_b: Column) -> Column:
    return pin_conflict(a, b) | numeric_conflict(a, b) | geographic_conflict(country_a, country_b, a, b)


def apply(scored: DataFrame, vetoed: str = "veto", score: str = "score") -> DataFrame:
    return scored.withColumn(score, F.when(F.col(vetoed), 0.0).otherwise(F.col(score)))
