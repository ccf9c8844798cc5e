"""Alerts from a stream into a table, each at most once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def deliver_to(path: str, alert_id: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function writing each micro-batch to its own folder.

    A batch that is repeated after a failure overwrites its folder, so nothing is delivered twice.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([alert_id]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return deliver


def delivered(spark: SparkSession, path: str, schema) -> DataFrame:
    """All alerts delivered so far."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
