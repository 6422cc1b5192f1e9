"""Decisions: at most one reference record a query, by absolute threshold and margin over the runner-up.

Input is (query_id, s1_id, score); ties go to the lower s1_id. Output has the accepted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PAIR = ("query_id", "s1_id", "score")


def best_two(scored: DataFrame) -> DataFrame:
    """(query_id, s1_id, score, runner_up): each query's best row and the next score, null without one."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "s1_id")
    ranked = scored.select(*_PAIR, F.row_number().over(w).alias("rn")).where("rn <= 2")
    return ranked.groupBy("query_id").agg(F.max(F.when(F.col("rn") == 1, F.col("s1_id"))).alias("s1_id"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("runner_up"))


def _clear(margin: float):
    return F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") >= margin)


def main(scored: DataFrame, absolute: float, margin: float, exclusive: bool = True) -> DataFrame:
    """The margin counts against the runner-up among rows that reach the threshold; not exclusive: all such rows."""
    passed = scored.where(F.col("score") >= absolute)
    if not exclusive:
        return passed.select(*_PAIR)
    best = best_two(passed)
    return (best.where(_clear(margin)) if margin > 0 else best).select(*_PAIR)


def hybrid(scored: DataFrame, absolute: float, margin: float) -> DataFrame:
    """The margin counts against the runner-up among all candidates, always."""
    return best_two(scored).where((F.col("score") >= absolute) & _clear(margin)).select(*_PAIR)


def late(scored: DataFrame, absolute: float, margin: float) -> DataFrame:
    """As hybrid, but a margin of 0 asks for none."""
    best = best_two(scored).where(F.col("score") >= absolute)
    return (best.where(_clear(margin)) if margin > 0 else best).select(*_PAIR)


def sieve(locked: DataFrame, scored: DataFrame, absolute: float, margin: float) -> DataFrame:
    """Locked pairs (query_id, s1_id) as they are, with score 1; the other queries as late."""
    rest = scored.join(locked.select("query_id").distinct(), "query_id", "left_anti")
    return locked.select("query_id", "s1_id", F.lit(1.0).alias("score")).unionByName(late(rest, absolute, margin))
