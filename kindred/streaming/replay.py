"""Replay of query files as a stream: each micro-batch is blocked, scored and decided as a batch is, and appended.

Queries are independent of each other, so the appended result does not depend on how files fall into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def replay(spark: SparkSession, source: str, schema, decide: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 1) -> None:
    """Runs a folder of parquet files to its end, `files` of them a micro-batch; decide: queries to rows.

    A micro-batch writes to a folder of its own number, overwritten if it is run again, so each row arrives once.
    """

    def one(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
