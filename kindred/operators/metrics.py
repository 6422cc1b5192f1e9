"""Entity-level evaluation over edge tables (s1_id, query_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIR = ["s1_id", "query_id"]


def counts(ids: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_pred, n_hit) of every id in ids (column s1_id)."""
    t = truth.select(*_PAIR, F.lit(1).alias("t"), F.lit(0).alias("p")).distinct()
    p = predicted.select(*_PAIR, F.lit(0).alias("t"), F.lit(1).alias("p")).distinct()
    pairs = t.unionByName(p).groupBy(*_PAIR).agg(F.max("t").alias("t"), F.max("p").alias("p"))
    by = pairs.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("n_hit"))
    return ids.select("s1_id").distinct().join(by, "s1_id", "left").select("s1_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "n_pred", "n_hit")))


def scored(by: DataFrame, beta: float = 0.5) -> DataFrame:
    """Adds precision, recall and f: all 1 where nothing is true or predicted, all 0 without a hit."""
    none = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    p, r = F.col("n_hit") / F.col("n_pred"), F.col("n_hit") / F.col("n_true")
    b = beta * beta
    case = lambda x: F.when(none, 1.0).when(F.col("n_hit") == 0, 0.0).otherwise(x)
    return by.withColumns({"precision": case(p), "recall": case(r), "f": case((1 + b) * p * r / (b * p + r))})


def macro(by: DataFrame, beta: float = 0.5, digits: int | None = 4, singletons_recalled: bool = False) -> DataFrame:
    """One row: n, precision, recall, f, means over all records. singletons_recalled: recall 1 wherever nothing is true."""
    x = scored(by, beta)
    if singletons_recalled:
        x = x.withColumn("recall", F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("recall")))
    fix = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return x.agg(F.count("*").alias("n"), *(fix(F.avg(c)).alias(c) for c in ("precision", "recall", "f")))


#: Channel: rank columns of which the least counts, and flags that count at no k.
CHANNELS = {"union": ("best_retrieval_rank",), "bm25": ("bm25_name_rank", "bm25_comb_rank"), "tfidf": ("tfidf_name_rank", "tfidf_addr_rank")}


def recall_at(truth: DataFrame, candidates: DataFrame, ks=(1, 5, 10, 20, 50)) -> DataFrame:
    """(channel, k, recall) of true pairs; k null: at any rank. Exact hits count for channel exact at any k; no truth: 1."""
    exact = F.greatest("by_exact_name", "by_exact_address", "by_exact_combined")
    ranks = {c: F.least(*r, F.lit(999)) if len(r) > 1 else F.col(r[0]) for c, r in CHANNELS.items()} | {"exact": F.when(exact == 1, 1).otherwise(999)}
    hit = truth.select(*_PAIR).distinct().join(candidates.select(*_PAIR, *(x.alias(c) for c, x in ranks.items())), _PAIR, "left")
    rate = lambda x: F.coalesce(F.avg(F.when(x, 1.0).otherwise(0.0)), F.lit(1.0))
    cells = [F.struct(F.lit(c).alias("channel"), F.lit(k).cast("int").alias("k"), F.round(rate(F.col(c) <= k), 6).alias("recall")) for c in ranks for k in ks]
    cells.append(F.struct(F.lit("union").alias("channel"), F.lit(None).cast("int").alias("k"), F.round(rate(F.col("union").isNotNull()), 6).alias("recall")))
    return hit.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def recall_slices(truth: DataFrame, candidates: DataFrame, query: DataFrame, script: Column) -> DataFrame:
    """(slice, value, n, hits, recall) by script, country, missing fields, source and number of matches of the record."""
    many = F.when(F.col("m") > 1, "multi").otherwise("one")
    missing = F.when((F.col("business_name") == "") & (F.col("business_address") == ""), "both").when(F.col("business_name") == "", "name").when(F.col("business_address") == "", "address").otherwise("none")
    q = query.select(F.col("entity_id").alias("query_id"), script.alias("script"), F.col("country"), missing.alias("missing"), F.substring("entity_id", 1, 2).alias("source"))
    m = truth.groupBy("s1_id").agg(F.countDistinct("query_id").alias("m"))
    rows = truth.select(*_PAIR).distinct().join(m, "s1_id").join(q, "query_id").join(candidates.select(*_PAIR, F.lit(1).alias("hit")).distinct(), _PAIR, "left")
    tall = rows.select(F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(F.array(*(F.struct(F.lit(s).alias("slice"), v.alias("value")) for s, v in (("script", F.col("script")), ("country", F.col("country")), ("missing", F.col("missing")), ("source", F.col("source")), ("cardinality", many))))).alias("s"))
    return tall.groupBy("s.slice", "s.value").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("recall"))


def errors(truth: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Missed pairs (CANDIDATE_GENERATION_FAILURE or MATCHER_THRESHOLD_FAILURE) and false ones (WRONG_MERGE), columns of both kinds."""
    t, p = truth.select(*_PAIR).distinct(), predicted.select(*_PAIR).distinct()
    missed = t.join(p, _PAIR, "left_anti").join(candidates.select(*_PAIR, F.lit(1).alias("c")).distinct(), _PAIR, "left")
    fn = missed.select(F.lit("FALSE_NEGATIVE").alias("error_type"), F.when(F.col("c") == 1, "MATCHER_THRESHOLD_FAILURE").otherwise("CANDIDATE_GENERATION_FAILURE").alias("failure_mechanism"), "query_id", "s1_id")
    fp = p.join(t, _PAIR, "left_anti").select(F.lit("FALSE_POSITIVE").alias("error_type"), F.lit("WRONG_MERGE").alias("failure_mechanism"), "query_id", F.col("s1_id").alias("predicted_s1_id"))
    return fn.unionByName(fp, allowMissingColumns=True)


def cardinality_accuracy(by: DataFrame) -> DataFrame:
    """(kind, n, correct, accuracy) of records with 0, 1 or more true matches; correct: the predicted set is the true one."""
    kind = F.when(F.col("n_true") == 0, "zero").when(F.col("n_true") == 1, "one").otherwise("multi")
    right = ((F.col("n_true") == F.col("n_pred")) & (F.col("n_hit") == F.col("n_true"))).cast("int")
    return by.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(right).alias("correct"), F.round(F.avg(right), 6).alias("accuracy"))


def cardinality(by: DataFrame, column: str = "n_pred") -> DataFrame:
    """One row: zero, single, multi."""
    c = F.col(column)
    return by.agg(*(F.count(F.when(x, 1)).alias(k) for k, x in (("zero", c == 0), ("single", c == 1), ("multi", c > 1))))


def grid(ids: DataFrame, truth: DataFrame, best: DataFrame, absolutes, margins, beta: float = 0.5) -> DataFrame:
    """(abs, margin, precision, recall, f) over all cells, from best rows and runners-up computed once.

    A record's counts change with the cell only through its own best rows, so cells meet (record, prediction) rows, never
    candidates; records without a prediction are added as a constant.
    """
    t = truth.select(*_PAIR).distinct()
    size = ids.select("s1_id").distinct().join(t.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").select("s1_id", F.coalesce("n_true", F.lit(0)).alias("n_true"))
    rows = best.join(t.withColumn("hit", F.lit(1)), _PAIR, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    cells = F.array(*(F.struct(F.lit(float(a)).alias("abs"), F.lit(float(m)).alias("margin")) for a in absolutes for m in margins))
    met = rows.withColumn("cell", F.explode(cells)).where((F.col("score") >= F.col("cell.abs")) & ((F.col("cell.margin") == 0) | F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") >= F.col("cell.margin"))))
    by = met.groupBy("cell.abs", "cell.margin", "s1_id").agg(F.count("*").alias("n_pred"), F.sum("hit").alias("n_hit"))
    got = scored(by.join(size, "s1_id"), beta).withColumn("bare", F.when(F.col("n_true") == 0, 1.0).otherwise(0.0))
    sums = got.groupBy("abs", "margin").agg(*(F.sum(F.col(c) - F.col("bare")).alias(c) for c in ("precision", "recall", "f")))
    base = size.agg(F.count("*").alias("n"), F.sum(F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)).alias("bare"))
    every = ids.sparkSession.range(1).select(F.explode(cells).alias("c")).select("c.*")
    full = every.join(sums, ["abs", "margin"], "left").join(F.broadcast(base))
    return full.select("abs", "margin", *(F.round((F.coalesce(c, F.lit(0.0)) + F.col("bare")) / F.col("n"), 6).alias(c) for c in ("precision", "recall", "f")))


def grid_best(cells: DataFrame) -> DataFrame:
    """The first cell of highest f, in order of (abs, margin)."""
    return cells.orderBy(F.desc("f"), "abs", "margin").limit(1)


def log_loss(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    return df.agg(F.round(F.avg(-F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q))), 6).alias("log_loss"))
