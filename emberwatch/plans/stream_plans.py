"""Queries of the streaming forms (X1-X5): the tables are read as streams, the oracles are the batch ones."""

from __future__ import annotations

from emberwatch.operators.alerts import classify, normalise_failures
from emberwatch.operators.policy import Policy
from emberwatch.operators.scan import finding_rows, scan
from emberwatch.plans import alert_plans, corpus, health_plans, scan_plans
from emberwatch.session import run_dir
from emberwatch.streaming.delivery import deliver_to, delivered
from emberwatch.streaming.late import split_late
from emberwatch.streaming.runner import drain, drain_batches, parquet_stream
from emberwatch.streaming.stateful import burst_counts, cooldown, restart_events


def _classified(spark, sf):
    events = parquet_stream(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    return classify(normalise_failures(alert_plans.nested(events)))


def _on_time(spark, sf):
    """What the state may see; later rows would be in the table beside it."""
    return split_late(_classified(spark, sf), "ts", 600)[0]


def x1(spark, sf):
    events = parquet_stream(spark, sf, "events", "event_id", "user_id")
    return drain(finding_rows(scan(corpus.fill(events), Policy()), "snippet_id").drop("sev_rank"))


def x2(spark, sf):
    return drain(cooldown(_on_time(spark, sf), 6 * 3600))


def x3(spark, sf):
    return drain(burst_counts(_on_time(spark, sf), alert_plans.WINDOW, 12))


def x4(spark, sf):
    events = parquet_stream(spark, sf, "events", "event_id", "ts", "user_id")
    return drain(restart_events(health_plans.samples(events), health_plans.LIMITS))


def x5(spark, sf):
    alerts = cooldown(_on_time(spark, sf), 6 * 3600)
    path = f"{run_dir(spark, 'alerts')}/table"
    drain_batches(alerts, deliver_to(path, "event_id"))
    return delivered(spark, path, alerts.schema)


_X2_SQL = alert_plans.QUERIES["E6_long_cooldown"][1]
_X3_SQL = f"WITH {alert_plans.COUNTED} SELECT event_id, at_us, window_count, window_count >= 12 AS is_burst FROM counted"

QUERIES = {
    "X1_streaming_scan": (x1, scan_plans.QUERIES["L8_combined_scan"][1]),
    "X2_streaming_cooldown": (x2, _X2_SQL),
    "X3_streaming_burst": (x3, _X3_SQL),
    "X4_streaming_health": (x4, health_plans.QUERIES["P6_restart_budget"][1]),
    "X5_alert_delivery": (x5, _X2_SQL),
}
