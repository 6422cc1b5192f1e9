"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
    return r.n, int(r.s)


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(node, root) for every node of edges (u, v), any order, repeats and loops allowed; root: the least node reachable.

    Each step joins edges to one row per node (its least neighbour), so a node of many neighbours is a skewed join that
    adaptive execution splits, never a collected group. Each round is written to the shared folder; the driver sees two
    numbers a round. rows: about how many edges there are, for the number of files.
    """
    e = common.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    state = _state(e)
    while state[0]:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        e = common.cut(sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star", state[0])
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u")
        e = common.cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small-star", state[0])
        state, before = _state(e), state
        if state == before:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
