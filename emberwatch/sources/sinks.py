"""Sinks (S7, S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.report import report


def with_report(scanned: DataFrame) -> DataFrame:
    """Add the text report of each scanned snippet."""
    return scanned.withColumn(
        "report", report(F.col("findings"), F.col("max_severity"), F.col("blocked"), F.col("tainted_vars"))
    )


def write_reports(scanned: DataFrame, path: str) -> None:
    """Reports as parquet, one row per snippet."""
    with_report(scanned).select("snippet_id", "blocked", "max_severity", "report").write.mode("overwrite").parquet(path)


def signal_rows(signals: DataFrame, window_seconds: int) -> DataFrame:
    """Burst signals in the form readers of the stop signal expect."""
    return signals.select(
        "reason",
        F.col("burst_count").alias("count"),
        F.lit(window_seconds).alias("window_sec"),
        (F.col("started_at") / 1_000_000).alias("timestamp"),
        F.concat_ws("-", "started_at", "event_id").alias("signal_id"),
    )


def write_signals(signals: DataFrame, window_seconds: int, path: str) -> None:
    """Add burst signals as JSON rows; earlier ones stay. ``read_signals`` gives a signal once however often it was written."""
    signal_rows(signals, window_seconds).write.mode("append").json(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Every signal written to the path, once."""
    return spark.read.json(path).dropDuplicates(["signal_id"])
