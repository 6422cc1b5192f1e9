"""Scans: parquet tables, tab-separated record files, ground truth, and the record views of the driver's tables."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

SOURCES = ("S1", "S2", "S3")
RECORD = ("entity_id", "business_name", "business_address", "country")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores where its scan has fewer splits than these (one small file); larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def record_file(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """A tab-separated file of records with a header: all strings, missing as the empty string, the word NA kept.

    required: a missing column is an error; else it is added empty. Extra columns stay.
    """
    df = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("quote", "").option("nullValue", "\x00").option("emptyValue", "").csv(path)
    if lost := [c for c in RECORD if c not in df.columns]:
        if required:
            raise ValueError(f"{path}: columns missing: {', '.join(lost)}")
        df = df.withColumns({c: F.lit("") for c in lost})
    return df.withColumns({c: text.strip(c) for c in RECORD})


def discovered(spark: SparkSession, root: str) -> dict[str, str]:
    """Paths of the record and truth files below root, by name: train_source1 ... test_source3, train_ground_truth.

    The least folder in order of names that holds both a train and a test folder; in these a file is known by its name with any
    beginning and end (*source1*.tsv). What is not there is left out. Spark's own file systems are asked, so remote roots work.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    found, out = fs.listFiles(path, True), {}
    files: dict[str, list[str]] = {}
    while found.hasNext():
        at = found.next().getPath().toString()
        files.setdefault(posixpath.dirname(at), []).append(at)
    homes = sorted(posixpath.dirname(d) for d in files if posixpath.basename(d) == "train" and posixpath.join(posixpath.dirname(d), "test") in files)
    home = homes[0] if homes else fs.makeQualified(path).toString()
    for side in ("train", "test"):
        for kind in ("source1", "source2", "source3", "ground_truth"):
            here = sorted(x for x in files.get(posixpath.join(home, side), files.get(home, [])) if kind in os.path.basename(x) and x.endswith(".tsv") and (homes or side in os.path.basename(x)))
            if here:
                out[f"{side}_{kind}"] = here[0]
    return out


def capped(queries: DataFrame, max_queries: int | None, order: str = "entity_id") -> DataFrame:
    """The first max_queries of the queries by order, exactly; all if it is None. A stated limit, for trial runs."""
    return queries if max_queries is None else queries.orderBy(order).limit(max_queries)


def by_source(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose id is among ids (entity_id), scanned only for the sources (id prefixes) that occur in ids; none: no rows, same columns."""
    prefixes = [r.p for r in ids.select(F.substring_index("entity_id", "-", 1).alias("p")).distinct().limit(len(SOURCES) + 1).collect()]
    if not prefixes:
        return records.where(F.lit(False))
    wanted = F.lit(True) if len(prefixes) > len(SOURCES) else F.substring_index("entity_id", "-", 1).isin(prefixes)
    return records.where(wanted).join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def truth_file(spark: SparkSession, path: str) -> DataFrame:
    """Edges (s1_id, query_id) of a file of comma-separated lists; see truth_edges."""
    schema = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("matched_entity_ids", T.StringType())])
    return truth_edges(spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path))


def truth_edges(lists: DataFrame) -> DataFrame:
    """One row for each different, non-empty, trimmed id of a list; lists without any have none."""
    ids = F.array_distinct(F.filter(F.transform(F.split(text.text("matched_entity_ids"), ","), text.strip), lambda x: x != ""))
    return lists.select(text.strip("source1_entity_id").alias("s1_id"), F.explode(ids).alias("query_id")).distinct()


def reverse_map(edges: DataFrame, order: str = "s1_id") -> DataFrame:
    """(query_id, s1_id): one reference record a query, the last by `order` if lists disagree."""
    return edges.groupBy("query_id").agg(F.max_by("s1_id", order).alias("s1_id"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the name, the other lines the address, lang the country; sources go round by doc_id."""
    t = text.text("text")
    rest = F.when(F.instr(t, "\n") > 0, F.replace(F.expr("substring(coalesce(text, ''), instr(coalesce(text, ''), '\n') + 1)"), F.lit("\n"), F.lit(" "))).otherwise("")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.substring_index(t, "\n", 1).alias("business_name"), rest.alias("business_address"), text.text("lang").alias("country"), "doc_id",
    )


RECORDS_SQL = """records AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, split_part(coalesce(text, ''), chr(10), 1) AS business_name,
  CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 THEN replace(substr(text, strpos(text, chr(10)) + 1), chr(10), ' ') ELSE '' END AS business_address,
  coalesce(lang, '') AS country, doc_id FROM documents)"""


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (S1) and suppliers (S2, S3 by parity of their key) as records of short fields, with key."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", F.replace("n_name", F.lit("_"), F.lit(" ")).alias("n_name"), "r_name")
    both = (
        table(spark, sf_dir, "customer")
        .select(F.lit("S1").alias("s"), F.col("c_custkey").alias("key"), F.col("c_name").alias("business_name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("more"))
        .unionByName(table(spark, sf_dir, "supplier").select(F.when(F.expr("s_suppkey % 2 = 0"), "S2").otherwise("S3").alias("s"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("business_name"), F.col("s_nationkey").alias("nation"), F.lit("").alias("more")))
    )
    # unhinted, adaptive plans broadcast the parties once their size is known, and the task of the nations' one split goes on with all of them
    return spread(both).join(F.broadcast(nations), F.expr("nation = n_nationkey")).select(
        F.concat_ws("-", "s", F.col("key").cast("string")).alias("entity_id"), "business_name", F.trim(F.concat_ws(" ", "n_name", "more")).alias("business_address"), F.col("r_name").alias("country"), "key"
    )


PARTIES_SQL = """parties AS (SELECT s || '-' || key AS entity_id, business_name, trim(replace(n_name, '_', ' ') || ' ' || more) AS business_address, r_name AS country, key
  FROM (SELECT 'S1' AS s, c_custkey AS key, c_name AS business_name, c_nationkey AS nation, c_mktsegment AS more FROM customer
        UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'S2' ELSE 'S3' END, s_suppkey, s_name, s_nationkey, '' FROM supplier) p
  JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def reference_side(records: DataFrame) -> DataFrame:
    return records.where(F.col("entity_id").startswith("S1-"))


def query_side(records: DataFrame) -> DataFrame:
    return records.where(~F.col("entity_id").startswith("S1-"))
