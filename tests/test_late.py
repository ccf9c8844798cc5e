"""Files out of order: every row is either worked on or in the late table."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberwatch.functions.text import micros
from emberwatch.operators import alerts as A
from emberwatch.plans import alert_plans
from emberwatch.streaming import stateful
from emberwatch.streaming.late import split_late
from emberwatch.streaming.runner import drain

DAY = 86400


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Quarters of the events, the last one before the third and the first at the end."""
    folder = tmp_path_factory.mktemp("shuffled")
    parts = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("part", F.ntile(4).over(Window.orderBy("ts")))
    for i in (2, 4, 3, 1):
        parts.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def live(spark, folder):
    schema = spark.read.parquet(folder).schema
    return A.classify(A.normalise_failures(alert_plans.nested(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))))


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


@pytest.mark.parametrize("delay", [DAY, 3650 * DAY])
def test_no_row_is_lost(spark, shuffled, delay):
    on_time, late = split_late(live(spark, shuffled), "ts", delay)
    known = drain(on_time)
    everything = ids(spark.read.parquet(shuffled))
    assert sorted(ids(known) + ids(late)) == everything
    assert (late.count() > len(everything) / 4) == (delay == DAY)
    # The operators keep all of what is on time: the same as over a table of it.
    columns = ("event_id", "window_count", "is_burst")
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    counted = stateful.burst_counts(on_time, 7200, 4, watermark=f"{delay} seconds")
    batch = A.burst_counts(known.withColumn("at_us", micros("ts")), window_seconds=7200, threshold=4)
    assert rows(drain(counted)) == rows(batch) != []
    alerts = drain(stateful.cooldown(on_time, 6 * 3600, watermark=f"{delay} seconds"))
    assert ids(alerts) == ids(A.alert_points(known.withColumn("at_us", micros("ts")), cooldown_seconds=6 * 3600))
