"""Profiles of record tables and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.readers import RECORD


def source(records: DataFrame) -> DataFrame:
    """(metric, value, n, pct): rows, distinct ids, missing fields, histograms of country and of the name's script."""
    total = records.agg(F.count("*").alias("rows"), F.countDistinct("entity_id").alias("ids"), *(F.count(F.when(F.col(c) == "", 1)).alias(c) for c in RECORD[1:]))
    head = total.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(v).alias("value"), F.col(c).alias("n")) for m, v, c in [("rows", "", "rows"), ("distinct_ids", "", "ids"), *(("missing", c, c) for c in RECORD[1:])]))).alias("m")).select("m.*")
    tall = records.select(F.explode(F.array(F.struct(F.lit("country").alias("metric"), F.col("country").alias("value")), F.struct(F.lit("script").alias("metric"), text.script("business_name").alias("value")))).alias("m"))
    both = head.unionByName(tall.groupBy("m.metric", "m.value").agg(F.count("*").alias("n")))
    return both.join(F.broadcast(total.select("rows"))).select("metric", "value", "n", F.when(F.col("rows") > 0, F.round(F.col("n") * 100.0 / F.col("rows"), 4)).otherwise(0.0).alias("pct"))


def truth(reference: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: records with 0, 1 and more matches, their percentages, mean and greatest number."""
    by = reference.select(F.col("entity_id").alias("s1_id")).distinct().join(edges.groupBy("s1_id").agg(F.countDistinct("query_id").alias("m")), "s1_id", "left").select(F.coalesce("m", F.lit(0)).alias("m"))
    kinds = {"zero": F.col("m") == 0, "one": F.col("m") == 1, "multi": F.col("m") > 1}
    return by.agg(F.count("*").alias("n"), *(F.count(F.when(c, 1)).alias(k) for k, c in kinds.items()), *(F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 4).alias(f"{k}_pct") for k, c in kinds.items()), F.round(F.avg("m"), 6).alias("avg_matches"), F.max("m").alias("max_matches"))
