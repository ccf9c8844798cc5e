"""Reading parquet tables with the columns a job needs."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task where each costs about half a millisecond: some seconds a task, however large the table is.
ROWS_PER_TASK = 10_000


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of a folder of parquet files; only the named columns reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input of few splits; an input with enough of them is left as it is.

    A single small file is one task, which matters for CPU-heavy narrow work. Large inputs have more
    splits than cores, so they are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def dealt(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal narrow rows that start much work over tasks of about ``rows_per_task``, however their files are split.

    A file's splits say little of its rows: splits without the start of a row group are empty, and a few hundred bytes of encoded ids
    may be a million rows. Rows are counted from the files' footers and dealt in turn, so equal or missing keys don't meet.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, ceil(df.count() / rows_per_task)))
