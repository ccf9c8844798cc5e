"""Queries and oracles of process and service health (S3, S4, P1-P8), on rows derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions.text import micros
from emberwatch.operators.health import Budget, failure_windows, gate, restart_events
from emberwatch.operators.processes import high_memory, latest, memory_alerts, restart_notice, restarts, status_line
from emberwatch.plans.alert_plans import thinned_sql
from emberwatch.sources.readers import health_status, process_snapshots
from emberwatch.sources.tables import table

# One poll payload per event: a process named after the user, some with missing fields.
_PAYLOAD = """concat('[{', CASE WHEN user_id % 11 = 0 THEN '' ELSE concat('"name":"p', CAST(user_id % 40 AS VARCHAR(20)), '",') END,
CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('"restart_time":', CAST(event_id % 7 AS VARCHAR(20)), ',') END,
CASE WHEN event_type = 'view' THEN '' ELSE concat('"monit":{"memory":', CAST(event_id * 7919237 % 2000000000 AS VARCHAR(20)), '},') END,
'"pm2_env":{"status":"', CASE event_type WHEN 'error' THEN 'stopped' WHEN 'click' THEN 'errored' ELSE 'online' END,
'","restart_time":', CAST(event_id % 5 AS VARCHAR(20)), '}},{"name":"q', CAST(user_id % 3 AS VARCHAR(20)), '"}]')"""


def _polls(spark, sf):
    events = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    return events.select(
        F.col("event_id").alias("snapshot_id"), micros("ts").alias("at_us"), F.expr(_PAYLOAD).alias("payload")
    )


def _snapshots(spark, sf):
    return process_snapshots(_polls(spark, sf))


# The oracle states the same rows from the event's columns, without JSON.
_SNAPSHOTS = """snaps AS (
SELECT event_id AS snapshot_id, epoch_us(ts) AS at_us, CASE WHEN user_id % 11 = 0 THEN '?' ELSE 'p' || (user_id % 40) END AS name,
 CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 7 END AS restarts,
 CASE WHEN event_type = 'view' THEN 0 ELSE event_id * 7919237 % 2000000000 END AS mem_bytes,
 CASE event_type WHEN 'error' THEN 'stopped' WHEN 'click' THEN 'errored' ELSE 'online' END AS status, event_id % 5 AS env_restarts FROM events
UNION ALL SELECT event_id, epoch_us(ts), 'q' || (user_id % 3), 0, 0, '?', 0 FROM events)"""


def s3(spark, sf):
    return _snapshots(spark, sf)


def p1(spark, sf):
    rows = restarts(_snapshots(spark, sf))
    notice = restart_notice(F.col("restarts"), F.col("status"), F.col("mem_bytes"))
    return rows.select("snapshot_id", "name", "previous_restarts", "restarts", notice.alias("notice"))


P1_SQL = f"""WITH {_SNAPSHOTS}, paired AS (SELECT *, lag(restarts) OVER (PARTITION BY name ORDER BY at_us, snapshot_id) AS previous_restarts FROM snaps)
SELECT snapshot_id, name, previous_restarts, restarts, '<b>Restart #:</b> ' || restarts || chr(10) || '<b>Status:</b> ' || status || chr(10)
|| '<b>Memory now:</b> ' || CAST(round_even(mem_bytes / 1048576.0, 0) AS BIGINT) || ' MB' AS notice
FROM paired WHERE previous_restarts > 0 AND restarts > previous_restarts"""


def p2(spark, sf):
    return high_memory(_snapshots(spark, sf)).select("snapshot_id", "name", "mem_bytes")


def _memory(seconds):
    def query(spark, sf):
        return memory_alerts(_snapshots(spark, sf), cooldown_seconds=seconds).select("snapshot_id", "name", "at_us")

    sql = f"""WITH RECURSIVE {_SNAPSHOTS}, high AS (SELECT * FROM snaps WHERE mem_bytes >= 1073741824),
{thinned_sql('high', 'name', seconds * 1_000_000, 'at_us')}
SELECT min(snapshot_id) AS snapshot_id, name, at_us FROM high JOIN kept ON name = k AND at_us = t GROUP BY name, at_us"""
    return query, sql


# Health answers: eight services, each disturbed on some days; some answers are unreadable or missing.
_ANSWER = """CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '{broken' WHEN event_id % 23 = 0 THEN '{}'
WHEN CAST(event_id / 400 AS INT) % 3 < 2 THEN '{"db":"disconnected"}' ELSE '{"db":"connected"}' END"""
_SERVICE = "concat('s', CAST(user_id % 8 AS VARCHAR(20)))"


def _samples(spark, sf):
    return samples(table(spark, sf, "events", "event_id", "ts", "user_id"))


def samples(events):
    """Health samples of event rows, from a table or a stream."""
    return events.select(
        F.col("event_id").alias("sample_id"), micros("ts").alias("at_us"), F.expr(_SERVICE).alias("service"),
        health_status(F.expr(_ANSWER.replace("CAST(event_id / 400 AS INT)", "(event_id div 400)"))).alias("status"),
    )


_SAMPLES = """samples AS (SELECT event_id AS sample_id, epoch_us(ts) AS at_us, 's' || (user_id % 8) AS service,
CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'unknown'
WHEN event_id // 400 % 3 < 2 THEN 'disconnected' ELSE 'connected' END AS status FROM events)"""
# Events are minutes apart, so the query uses hours where the defaults are seconds.
_HOUR = 3_600_000_000
LIMITS = Budget(check=_HOUR // 2, window=6 * _HOUR, threshold=3, cooldown=8 * _HOUR, max_restarts=3, healthy_reset=12 * _HOUR)


def s4(spark, sf):
    return _samples(spark, sf)


def _gate(seconds):
    def query(spark, sf):
        return gate(_samples(spark, sf), seconds=seconds).select("sample_id", "service", "at_us")

    sql = f"""WITH RECURSIVE {_SAMPLES}, {thinned_sql('samples', 'service', seconds * 1_000_000, 'at_us')}
SELECT min(sample_id) AS sample_id, service, at_us FROM samples JOIN kept ON service = k AND at_us = t GROUP BY service, at_us"""
    return query, sql


def p5(spark, sf):
    counted = failure_windows(_samples(spark, sf), seconds=6 * 3600, threshold=3)
    return counted.select("sample_id", "window_count", "triggers")


P5_SQL = f"""WITH {_SAMPLES}, counted AS (SELECT sample_id, count(*) OVER (PARTITION BY service ORDER BY at_us
RANGE BETWEEN {6 * _HOUR} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY service, at_us)
+ row_number() OVER (PARTITION BY service, at_us ORDER BY sample_id) AS window_count FROM samples WHERE status <> 'connected')
SELECT sample_id, window_count, window_count >= 3 AS triggers FROM counted"""


def p6(spark, sf):
    return restart_events(_samples(spark, sf), LIMITS)


def p7(spark, sf):
    patient = Budget(
        check=_HOUR // 2, window=6 * _HOUR, threshold=3, cooldown=8 * _HOUR, max_restarts=9, healthy_reset=2 * _HOUR
    )
    return restart_events(_samples(spark, sf), patient).filter("event = 'RECOVERED'")


def _machine_sql(limits: Budget, where: str) -> str:
    """The machine as a walk over ordered samples, one row of state per sample and service."""
    return f"""WITH RECURSIVE {_SAMPLES},
ordered AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY at_us, sample_id) AS n FROM samples),
walk(service, n, sample_id, at_us, event, restarts, next_at, healthy, fails) AS (
 SELECT DISTINCT service, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM ordered
 UNION ALL
 SELECT service, n, sample_id, at_us,
  CASE WHEN NOT due THEN '' WHEN status = 'connected' AND healthy > 0 AND restarts > 0 AND at_us - healthy >= {limits.healthy_reset} THEN 'RECOVERED'
       WHEN bad AND len(recent) >= {limits.threshold} THEN CASE WHEN restarts >= {limits.max_restarts} THEN 'SHUTDOWN' ELSE 'RESTART' END ELSE '' END,
  CASE WHEN NOT due THEN restarts WHEN status = 'connected' AND healthy > 0 AND restarts > 0 AND at_us - healthy >= {limits.healthy_reset} THEN 0
       WHEN bad AND len(recent) >= {limits.threshold} AND restarts < {limits.max_restarts} THEN restarts + 1 ELSE restarts END,
  CASE WHEN NOT due THEN next_at WHEN bad AND len(recent) >= {limits.threshold} THEN
       CASE WHEN restarts >= {limits.max_restarts} THEN {2**62} ELSE at_us + {max(limits.check, limits.cooldown)} END ELSE at_us + {limits.check} END,
  CASE WHEN NOT due THEN healthy WHEN status = 'connected' THEN CASE WHEN healthy = 0 THEN at_us ELSE healthy END WHEN bad THEN 0 ELSE healthy END,
  CASE WHEN NOT due THEN fails WHEN status = 'connected' AND healthy > 0 AND restarts > 0 AND at_us - healthy >= {limits.healthy_reset} THEN CAST([] AS BIGINT[])
       WHEN bad THEN CASE WHEN len(recent) >= {limits.threshold} THEN CAST([] AS BIGINT[]) ELSE recent END ELSE fails END
 FROM (SELECT o.service, o.n, o.sample_id, o.at_us, o.status, w.restarts, w.next_at, w.healthy, w.fails, o.at_us >= w.next_at AS due,
   coalesce(o.status <> 'connected', FALSE) AS bad,
   list_append(list_filter(w.fails, lambda x: x >= o.at_us - {limits.window}), o.at_us) AS recent
   FROM walk w JOIN ordered o ON o.service = w.service AND o.n = w.n + 1))
SELECT service, sample_id, at_us, event, restarts FROM walk WHERE {where}"""


def p8(spark, sf):
    by_env = latest(process_snapshots(_polls(spark, sf), counter="env"))
    line = status_line(F.col("name"), F.col("status"), F.col("restarts"), F.col("mem_bytes"))
    return by_env.select("name", line.alias("line"))


P8_SQL = f"""WITH {_SNAPSHOTS}, last AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY at_us DESC, snapshot_id DESC) AS n FROM snaps)
SELECT name, CASE status WHEN 'online' THEN '🟢' WHEN 'stopped' THEN '🔴' ELSE '🟡' END || ' <b>' || name || '</b> — ' || status
|| ', ↺' || env_restarts || ', ' || CASE WHEN mem_bytes = 0 THEN '?' ELSE (mem_bytes // 1024 // 1024) || 'MB' END AS line FROM last WHERE n = 1"""

QUERIES = {
    "S3_process_snapshots": (s3, f"WITH {_SNAPSHOTS} SELECT snapshot_id, at_us, name, restarts, mem_bytes, status FROM snaps"),
    "S4_health_samples": (s4, f"WITH {_SAMPLES} SELECT sample_id, at_us, service, status FROM samples"),
    "P1_restarts": (p1, P1_SQL),
    "P2_high_memory": (p2, f"WITH {_SNAPSHOTS} SELECT snapshot_id, name, mem_bytes FROM snaps WHERE mem_bytes >= 1073741824"),
    "P3_memory_alerts": _memory(300),
    "P3_memory_alerts_daily": _memory(86400),
    "P4_sample_gate": _gate(12),
    "P4_sample_gate_hourly": _gate(3600),
    "P5_failure_window": (p5, P5_SQL),
    "P6_restart_budget": (p6, _machine_sql(LIMITS, "event <> ''")),
    "P7_recovery": (
        p7,
        _machine_sql(
            Budget(check=_HOUR // 2, window=6 * _HOUR, threshold=3, cooldown=8 * _HOUR, max_restarts=9, healthy_reset=2 * _HOUR),
            "event = 'RECOVERED'",
        ),
    ),
    "P8_status_report": (p8, P8_SQL),
}
