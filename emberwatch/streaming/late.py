"""Rows that come later than a stream may wait, split off before the state and counted.

A stateful operator drops rows behind its watermark without a word. Here each micro-batch is split against the latest time of the
batches before it: what is behind goes to a table of late rows, the rest to a table that the operator reads as its stream, and of which its
watermark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import SECOND, micros
from emberwatch.session import run_dir
from emberwatch.streaming.runner import drain_batches


def split_late(stream: DataFrame, event_time: str, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) of what a stream has now: a stream and a table with its columns, which together have all of its rows.

    A row is late if its ``event_time`` is ``delay_seconds`` or more behind the latest of an earlier micro-batch; rows without a time are
    on time. Give the operator a watermark of the same delay or a longer one. A batch that is repeated after a failure overwrites what it
    wrote, so every row is in one table once.
    """
    spark, columns = stream.sparkSession, stream.columns
    folder = run_dir(spark, "late")
    at = micros(event_time)

    def deal(batch: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id:
            seen = batch.sparkSession.read.schema("latest bigint").parquet(*[f"{folder}/latest/{k}" for k in range(batch_id)])
            before = seen.agg(F.max("latest")).first()[0]
        batch.persist()
        behind = F.lit(False) if before is None else F.coalesce(at <= before - delay_seconds * SECOND, F.lit(False))
        batch.agg(F.max(at).alias("latest")).write.mode("overwrite").parquet(f"{folder}/latest/{batch_id}")
        batch.where(behind).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        batch.where(~behind).write.mode("overwrite").parquet(f"{folder}/on_time/batch={batch_id}")
        batch.unpersist()

    drain_batches(stream, deal)
    on_time = spark.readStream.schema(stream.schema).parquet(f"{folder}/on_time").select(*columns)
    return on_time, spark.read.schema(stream.schema).parquet(f"{folder}/late").select(*columns)
