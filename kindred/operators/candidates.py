"""Merging channels into candidates: one row a pair, by a tagged union and one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_RANK = 999
EXACT = ("exact_name", "exact_address", "exact_combined")
#: Channel, names of its score and rank columns.
RANKED = {"bm25_name": ("bm25_name_score", "bm25_name_rank"), "bm25_combined": ("bm25_comb_score", "bm25_comb_rank"), "tfidf_name": ("tfidf_name_score", "tfidf_name_rank"), "tfidf_address": ("tfidf_addr_score", "tfidf_addr_rank")}
HYBRID = ("exact_name", "exact_combined", "exact_address", "phonetic", "lsh", "token")


def _tagged(channels: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in channels.items():
        score = F.col("score").cast("double") if "score" in df.columns else F.lit(0.0)
        rank = F.col("rank").cast("int") if "rank" in df.columns else F.lit(NO_RANK)
        one = df.select("query_id", "s1_id", F.lit(name).alias("channel"), score.alias("score"), rank.alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


def merged(channels: dict[str, DataFrame]) -> DataFrame:
    """Flags, scores and ranks of the seven channels, with agreement count, best rank and its reciprocal (0 without any)."""
    is_ = lambda c: F.col("channel") == c
    flags = [F.max(F.when(is_(c), 1).otherwise(0)).alias(f"by_{c}") for c in (*EXACT, *RANKED)]
    values = [x for c, (s, r) in RANKED.items() for x in (F.max(F.when(is_(c), F.col("score")).otherwise(0.0)).alias(s), F.min(F.when(is_(c), F.col("rank")).otherwise(NO_RANK)).alias(r))]
    df = _tagged(channels).groupBy("query_id", "s1_id").agg(*flags, *values)
    best = F.least(*(F.col(r) for _, r in RANKED.values()))
    return df.withColumns({"retrieval_agreement_count": sum((F.col(f"by_{c}") for c in (*EXACT[1:], *RANKED)), F.col(f"by_{EXACT[0]}")), "best_retrieval_rank": best, "best_reciprocal_rank": F.when(best < NO_RANK, 1 / best).otherwise(0.0)})


def merged_hybrid(channels: dict[str, DataFrame], top_k: int = 15) -> DataFrame:
    """Flags and agreement of the six hybrid channels; the top_k of each query by agreement, then first channel, then s1_id."""
    order = F.create_map(*(x for i, c in enumerate(HYBRID) for x in (F.lit(c), F.lit(i))))
    rows = _tagged(channels).withColumn("o", order[F.col("channel")])
    df = rows.groupBy("query_id", "s1_id").agg(*(F.max(F.when(F.col("channel") == c, 1).otherwise(0)).alias(f"by_{c}") for c in HYBRID), F.min("o").alias("o"))
    df = df.withColumn("channel_agreement", sum((F.col(f"by_{c}") for c in HYBRID[1:]), F.col(f"by_{HYBRID[0]}")))
    w = Window.partitionBy("query_id").orderBy(F.desc("channel_agreement"), "o", "s1_id")
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_k).drop("o", "rn")


def priority_fill(channels: list[tuple[DataFrame, float | None]], k: int) -> DataFrame:
    """(query_id, s1_id, score, rank): all of the first channel, then others in order while a query has fewer than k.

    channels: (pairs, fixed score or None to take the pair's own); within a channel by its rank or position, then s1_id.
    """
    out = None
    for i, (df, fixed) in enumerate(channels):
        within = next((F.col(c) for c in ("rank", "position") if c in df.columns), F.lit(0)).cast("int")
        one = df.select("query_id", "s1_id", F.lit(i).alias("p"), within.alias("w"), (F.col("score") if fixed is None else F.lit(float(fixed))).alias("score"))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy("query_id", "s1_id").agg(F.min(F.struct("p", "w", "score")).alias("x")).select("query_id", "s1_id", "x.*")
    w = Window.partitionBy("query_id").orderBy("p", "w", "s1_id")
    return first.withColumn("rank", F.row_number().over(w)).where((F.col("p") == 0) | (F.col("rank") <= k)).select("query_id", "s1_id", "score", "rank")


def inject(candidates: DataFrame, edges: DataFrame, **fixed) -> DataFrame:
    """Candidates and the true pairs that retrieval missed, with fixed values (others null)."""
    more = edges.join(candidates, ["query_id", "s1_id"], "left_anti").select("query_id", "s1_id", *(F.lit(v).alias(k) for k, v in fixed.items()))
    return candidates.unionByName(more, allowMissingColumns=True)


def stats(candidates: DataFrame) -> DataFrame:
    """One row: n_queries, n_pairs, pairs_per_query."""
    return candidates.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_pairs"), F.round(F.count("*") / F.countDistinct("query_id"), 6).alias("pairs_per_query"))
