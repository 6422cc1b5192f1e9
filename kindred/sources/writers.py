"""Sinks: result files of one row per reference record, reports, thresholds and models."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Thresholds where no usable file has any.
DEFAULT_THRESHOLDS = {"abs_threshold": 0.65, "margin_threshold": 0.05}

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of this process only where it is unset, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="kindred-"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table to the shared folder and read back.

    For what is read more than once: unlike a persisted table it holds no memory once read, and lost executors do not undo it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collapsed(reference: DataFrame, edges: DataFrame, out: str = "matched_entity_ids", order: str | None = None) -> DataFrame:
    """(source1_entity_id, out) for every reference record: its query ids sorted and comma-joined, empty if none. order: a column to sort rows by."""
    lists = edges.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("query_id")), ",").alias(out))
    rows = reference.join(lists, reference.entity_id == lists.s1_id, "left")
    if order:
        rows = rows.orderBy(order)
    return rows.select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(out, F.lit("")).alias(out))


def subset_candidates(predicted: DataFrame, candidates: DataFrame, mode: str = "intersect") -> tuple[DataFrame, DataFrame]:
    """Predictions and candidates with the first within the second: `intersect` drops predictions that are no candidates, `extend` adds them."""
    pair = ["s1_id", "query_id"]
    if mode == "intersect":
        return predicted.join(candidates.select(*pair).distinct(), pair, "left_semi"), candidates
    return predicted, candidates.select(*pair).unionByName(predicted.select(*pair)).distinct()


def write_tsv(df: DataFrame, *paths: str) -> None:
    """The same tab-separated file with a header at each path."""
    for p in paths:
        df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(p)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_thresholds(path: str, absolute: float, margin: float, beta: float = 0.5, metrics: dict | None = None) -> None:
    Path(path).write_text(json.dumps({"abs_threshold": absolute, "margin_threshold": margin, "beta": beta, "metrics": metrics or {}}, indent=2))


def load_thresholds(path: str) -> dict:
    try:
        return DEFAULT_THRESHOLDS | json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return dict(DEFAULT_THRESHOLDS)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
