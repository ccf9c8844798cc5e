"""Values carried along a key's time line without putting the key into one task.

A plain ``lag`` or running ``last`` partitions by key, so a hot key is one task. These work on time
blocks of a key; the value a block starts with comes from a one-row-per-block summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_last(
    df: DataFrame, keys: list[str], at: str, tie: str, value: Column, name: str, block_us: int,
    include_current: bool = False,
) -> DataFrame:
    """Add ``name``: the latest non-NULL ``value`` of the key before (or up to) each row.

    Rows are ordered by ``at`` (BIGINT microseconds) and then ``tie``.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    marked = df.withColumn("_key", key).withColumn("_block", F.expr(f"{at} div {block_us}")).withColumn("_value", value)
    order = F.struct(at, tie)
    within = Window.partitionBy("_key", "_block").orderBy(at, tie).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if include_current else -1
    )
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        marked.groupBy("_key", "_block")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), order)).alias("_closing"))
        .select("_key", "_block", F.last("_closing", ignorenulls=True).over(earlier).alias("_opening"))
    )
    local = marked.withColumn("_local", F.last("_value", ignorenulls=True).over(within))
    joined = local.join(summary, ["_key", "_block"], "left")
    return joined.withColumn(name, F.coalesce("_local", "_opening")).drop("_key", "_block", "_value", "_local", "_opening")
