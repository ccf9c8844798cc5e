"""Starting streams with the state store they need, and draining what is available."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from emberwatch.session import run_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store; a store set by the cluster is left alone."""
    if "RocksDB" not in (spark.conf.get(_PROVIDER, "") or ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def parquet_stream(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of a folder of parquet files as a stream; the schema comes from the files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.select(*columns) if columns else rows


def start_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to parquet files, exactly once."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .option("path", path).trigger(availableNow=True).start()
    )


def drain(stream: DataFrame) -> DataFrame:
    """Process what a stream has now and return the result as a batch table."""
    spark = stream.sparkSession
    folder = run_dir(spark, "stream")
    start_to_table(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_batches(stream: DataFrame, deliver: Callable[[DataFrame, int], None]) -> None:
    """Process what a stream has now, handing each micro-batch to ``deliver``."""
    folder = run_dir(stream.sparkSession, "deliver")
    query = (
        stream.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
