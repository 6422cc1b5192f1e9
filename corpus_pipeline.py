"""A training-data pipeline of five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import common, decontaminate, pieces, quality, secrets, simhash

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("secret scans", secrets.stage),
    ("sentencepiece encoding", pieces.stage),
]
#: SQL can express neither the classifier nor the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
