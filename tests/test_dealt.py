"""The scan's corpus is dealt by rows, whatever the files' row groups and however often a key comes."""

import pytest
from pyspark.sql import functions as F

from emberwatch.plans.corpus import snippets
from emberwatch.sources.tables import ROWS_PER_TASK

ROWS = 12 * ROWS_PER_TASK


@pytest.mark.parametrize("key", ["id", "CAST(7 AS BIGINT)", "CAST(NULL AS BIGINT)"], ids=["distinct", "equal", "null"])
def test_one_row_group_is_many_tasks(spark, tmp_path, key):
    events = spark.range(ROWS).selectExpr(f"{key} AS event_id", "id * 7919 % 100003 AS user_id")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = snippets(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(r["count"] for r in got) == ROWS
    assert max(r["count"] for r in got) <= 1.2 * ROWS_PER_TASK
