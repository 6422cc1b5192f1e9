"""Samples and splits. What a seed shuffles there is an order by md5 of the id and the seed here: the same on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))


def bucket(id_col: str, seed: int = 42) -> Column:
    """0..99 by hash."""
    return (F.conv(F.substring(shuffled(id_col, seed), 1, 8), 16, 10).cast("long") % 100).cast("int")


def coherent(reference: DataFrame, query: DataFrame, truth: DataFrame, n_reference: int, n_target: int, n_unmatched: int, order: str = "entity_id", seed: int = 42) -> dict[str, DataFrame]:
    """reference: the first n by order; their edges; up to n_target of their queries in hash order; the first n_unmatched others; ids once."""
    ref = reference.orderBy(order).limit(n_reference)
    edges = truth.join(ref.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    targets = edges.select("query_id").distinct().orderBy(shuffled("query_id", seed), "query_id").limit(n_target)
    active = query.join(targets.withColumnRenamed("query_id", "entity_id"), "entity_id", "left_semi")
    others = query.join(truth.select(F.col("query_id").alias("entity_id")).distinct(), "entity_id", "left_anti").orderBy(order).limit(n_unmatched)
    return {"reference": ref, "query": first_rows(active.unionByName(others), "entity_id", order), "edges": edges.join(targets, "query_id", "left_semi")}


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Percent of validation records and what becomes of queries without a record, by variant.
SPLITS = {"main": (20, "split"), "hybrid": (20, "drop"), "sieve": (15, "halve")}
#: Fixed values of the late variant: records to train on, records to validate on.
LATE_SIZES = (10_000, 50_000)


def split_fixed(reference: DataFrame, query: DataFrame, truth: DataFrame, sizes: tuple[int, int] = LATE_SIZES, seed: int = 42) -> dict[str, DataFrame]:
    """Split of the late variant: that many records in hash order to train on, the next so many to validate on, with their queries and edges."""
    n, m = sizes
    order = [shuffled("entity_id", seed), F.col("entity_id")]
    train = reference.orderBy(*order).limit(n)
    both = reference.orderBy(*order).limit(n + m)
    val = both.join(train.select("entity_id"), "entity_id", "left_anti")
    out = {}
    for name, ref in (("train", train), ("val", val)):
        edges = truth.join(ref.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
        mine = edges.select(F.col("query_id").alias("entity_id")).distinct()
        out |= {f"{name}_reference": ref, f"{name}_query": query.join(mine, "entity_id", "left_semi"), f"{name}_edges": edges}
    return out


def split(reference: DataFrame, query: DataFrame, truth: DataFrame, val: int = 20, unmatched: str = "split", seed: int = 42) -> dict[str, DataFrame]:
    """Entity-disjoint halves train_* and val_* of reference, query and edges; val: percent by hash of the reference id.

    Queries go with their record. unmatched queries: split by their own hash (split), each half by another hash (halve), or dropped (drop).
    """
    out = {}
    owner = truth.groupBy("query_id").agg(F.min("s1_id").alias("s1_id"))
    sided = query.join(owner.withColumnRenamed("query_id", "entity_id"), "entity_id", "left")
    side_of = F.when(F.col("s1_id").isNotNull(), bucket("s1_id", seed)).otherwise({"split": bucket("entity_id", seed), "halve": F.when(bucket("entity_id", seed + 1) < 50, F.lit(0)).otherwise(F.lit(99))}.get(unmatched, F.lit(None)))
    sided = sided.withColumn("__b", side_of)
    for name, test in (("val", lambda b: b < val), ("train", lambda b: b >= val)):
        out[f"{name}_reference"] = reference.where(test(bucket("entity_id", seed)))
        out[f"{name}_query"] = sided.where(test(F.col("__b"))).drop("__b", "s1_id")
        out[f"{name}_edges"] = truth.where(test(bucket("s1_id", seed)))
    return out


#: Categories of negatives in order, with their shares.
QUOTAS = (("hard_lexical", 0.35), ("hard_address", 0.25), ("hard_retrieval", 0.20), ("same_country", 0.10), ("random", 0.10))


#: The features category() reads.
CATEGORY_COLUMNS = ("name_jaro_winkler", "name_fuzz_ratio", "addr_jaro_winkler", "addr_fuzz_ratio", "tfidf_name_score", "bm25_name_score", "best_retrieval_rank", "country_exact_match")


def category() -> Column:
    c = F.col
    return (
        F.when((c("name_jaro_winkler") >= 0.78) | (c("name_fuzz_ratio") >= 0.75), "hard_lexical")
        .when((c("addr_jaro_winkler") >= 0.72) | (c("addr_fuzz_ratio") >= 0.70), "hard_address")
        .when((c("tfidf_name_score") >= 0.35) | (c("bm25_name_score") >= 2.0) | (c("best_retrieval_rank") <= 3), "hard_retrieval")
        .when(c("country_exact_match") == 1, "same_country")
        .otherwise("random")
    )


def negatives(features: DataFrame, ratio: int = 8, seed: int = 42, label: str = "is_match", cat: str = "category") -> DataFrame:
    """All positives, and min(negatives, ratio * positives) negatives by quota of category, refilled from what is left, in hash order.

    Features have query_id, s1_id, label and category; a pair is there once. Without positives all rows come back. The
    driver sees counts by category; each quota is a limit in hash order, of which every task passes on only its least
    rows, so no category is ranked as a whole.
    """
    counts = {(r.y, r.c): r.n for r in features.groupBy((F.col(label) == 1).alias("y"), F.col(cat).alias("c")).agg(F.count("*").alias("n")).collect()}
    pos, neg = (sum(n for (y, _), n in counts.items() if bool(y) == one) for one in (True, False))
    if not pos:
        return features
    target = min(neg, ratio * pos)
    hashed = features.where(F.col(label) != 1).withColumn("__h", F.md5(F.concat_ws(":", "query_id", "s1_id", F.lit(str(seed))).cast("binary")))
    order = ["__h", "query_id", "s1_id"]
    quotas = {c: min(counts.get((False, c), 0), int(target * share + 1e-9)) for c, share in QUOTAS}
    taken = hashed.limit(0)
    for c, n in quotas.items():
        if n:
            taken = taken.unionByName(hashed.where(F.col(cat) == c).orderBy(*order).limit(n))
    missing = target - sum(quotas.values())
    refill = hashed.join(taken.select("query_id", "s1_id"), ["query_id", "s1_id"], "left_anti").orderBy(*order).limit(missing)
    return features.where(F.col(label) == 1).unionByName(taken.unionByName(refill.select(*taken.columns)).select(*features.columns))


def triplets(candidates: DataFrame, truth: DataFrame, seed: int = 42) -> DataFrame:
    """(query_id, positive_id, negative_id): of each true pair's query one retrieved record that is no match, the least by hash."""
    pair = ["query_id", "s1_id"]
    neg = candidates.select(*pair).distinct().join(truth.select(*pair), pair, "left_anti")
    one = neg.groupBy("query_id").agg(F.min_by("s1_id", F.struct(F.md5(F.concat_ws(":", *pair, F.lit(str(seed))).cast("binary")), "s1_id")).alias("negative_id"))
    return truth.select("query_id", F.col("s1_id").alias("positive_id")).distinct().join(one, "query_id")


def ranking_loss(positive: Column, negative: Column, margin: float = 0.2) -> Column:
    return F.greatest(F.lit(0.0), margin - positive + negative)
