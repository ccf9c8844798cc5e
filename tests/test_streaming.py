"""Streams read in several micro-batches give the batch results."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberwatch.functions.text import micros
from emberwatch.operators import alerts as A
from emberwatch.operators import health as H
from emberwatch.operators.policy import Policy
from emberwatch.operators.scan import finding_rows, scan
from emberwatch.plans import alert_plans, corpus, health_plans
from emberwatch.streaming import stateful
from emberwatch.streaming.delivery import deliver_to, delivered
from emberwatch.streaming.runner import drain, drain_batches


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Events in four files in time order, read one file per micro-batch."""
    folder = tmp_path_factory.mktemp("events")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    quarter = F.ntile(4).over(Window.orderBy("ts"))
    parts = events.withColumn("part", quarter)
    for i in range(1, 5):
        parts.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, files):
    schema = spark.read.parquet(files).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def classified(events):
    return A.classify(A.normalise_failures(alert_plans.nested(events)))


def test_cooldown_and_delivery(spark, files, tmp_path):
    live = stateful.cooldown(classified(stream(spark, files)), 6 * 3600)
    batch = A.alert_points(classified(spark.read.parquet(files)).withColumn("at_us", micros("ts")), cooldown_seconds=6 * 3600)
    columns = ("event_id", "at_us", "fingerprint")
    assert rows(drain(live), *columns) == rows(batch, *columns)
    deliver = deliver_to(str(tmp_path / "alerts"), "event_id")
    drain_batches(live, deliver)
    deliver(batch.filter("event_id < 0"), 99)
    assert rows(delivered(spark, str(tmp_path / "alerts"), live.schema), *columns) == rows(batch, *columns)


def test_burst_counts(spark, files):
    live = stateful.burst_counts(classified(stream(spark, files)), 7200, 4)
    batch = A.burst_counts(classified(spark.read.parquet(files)).withColumn("at_us", micros("ts")), window_seconds=7200, threshold=4)
    columns = ("event_id", "window_count", "is_burst")
    assert rows(drain(live), *columns) == rows(batch, *columns)


def test_health_machine(spark, files):
    live = stateful.restart_events(health_plans.samples(stream(spark, files)), health_plans.LIMITS)
    batch = H.restart_events(health_plans.samples(spark.read.parquet(files)), health_plans.LIMITS)
    columns = ("service", "sample_id", "at_us", "event", "restarts")
    assert rows(drain(live), *columns) == rows(batch, *columns) != []


def test_scan(spark, files):
    live = finding_rows(scan(corpus.fill(stream(spark, files)), Policy()), "snippet_id")
    batch = finding_rows(scan(corpus.fill(spark.read.parquet(files)), Policy()), "snippet_id")
    assert rows(drain(live), *batch.columns) == rows(batch, *batch.columns)
