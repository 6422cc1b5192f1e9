"""Checks of result files, as violation rows (file, rule, s1_id, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

HEADERS = {"matching": ("source1_entity_id", "matched_entity_ids"), "candidates": ("source1_entity_id", "candidate_entity_ids")}
#: Rules that don't fail a file.
WARNINGS = ("not_a_subset",)


def header(lines: DataFrame, file: str, first_line: str) -> DataFrame:
    """Of raw lines (column value): a wrong header, comma-separated ones told apart, and rows that haven't two fields."""
    want = "\t".join(HEADERS[file])
    spark = lines.sparkSession
    made = []
    if first_line != want:
        made.append((file, "not_tab_separated" if "\t" not in first_line and "," in first_line else "wrong_header", "", first_line))
    bad = lines.where((F.col("value") != first_line) & (F.size(F.split("value", "\t")) != 2))
    rows = bad.select(F.lit(file).alias("file"), F.lit("malformed_row").alias("rule"), F.lit("").alias("s1_id"), F.col("value").alias("detail"))
    return spark.createDataFrame(made, "file string, rule string, s1_id string, detail string").unionByName(rows)


def _ids(column: str) -> Column:
    return F.filter(F.transform(F.split(text.text(column), ","), text.strip), lambda x: x != "")


def lists(results: DataFrame, reference: DataFrame, file: str, known: DataFrame | None = None) -> DataFrame:
    """Violations of a result table (s1_id, ids as a comma-joined string) against the reference ids; known: query ids, if they are checked."""
    x = results.select(F.col("s1_id"), _ids("ids").alias("ids"))
    ref = reference.select(F.col("entity_id").alias("s1_id")).distinct()
    row = lambda df, rule, detail: df.select(F.lit(file).alias("file"), F.lit(rule).alias("rule"), "s1_id", detail.alias("detail"))
    each = x.select("s1_id", F.explode("ids").alias("id"))
    out = [
        row(x.groupBy("s1_id").count().where("count > 1"), "duplicate_row", F.col("count").cast("string")),
        row(each.groupBy("s1_id", "id").count().where("count > 1"), "duplicate_id", F.col("id")),
        row(each.where(F.col("id") == F.col("s1_id")), "self_match", F.col("id")),
        row(each.where(~F.col("id").rlike("^S[23]-") & (F.col("id") != F.col("s1_id"))), "wrong_prefix", F.col("id")),
        row(ref.join(x, "s1_id", "left_anti"), "missing_row", F.lit("")),
        row(x.select("s1_id").distinct().join(ref, "s1_id", "left_anti"), "unknown_row", F.lit("")),
    ]
    if known is not None:
        out.append(row(each.join(known.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti"), "unknown_id", F.col("id")))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole.distinct()


def subset(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warnings: matched ids of a record that are not among its candidates."""
    m = matching.select("s1_id", _ids("ids").alias("m"))
    c = candidates.select("s1_id", _ids("ids").alias("c"))
    extra = F.array_except("m", F.coalesce("c", F.array().cast("array<string>")))
    return m.join(c, "s1_id", "left").where(F.size(extra) > 0).select(F.lit("matching").alias("file"), F.lit("not_a_subset").alias("rule"), "s1_id", F.array_join(F.array_sort(extra), ",").alias("detail"))
