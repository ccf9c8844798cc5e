"""Queries and oracles of failure alerting (S2, S8, E1-E12, P9), on failures derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions.text import micros
from emberwatch.operators.alerts import (
    CLASS_LABELS, CODE_LABELS, alert_points, alertable, alerts, body, burst_counts, burst_signals, classify, excerpt,
    is_auth_failure, normalise_failures,
)
from emberwatch.operators.processes import stop_notice
from emberwatch.plans.corpus import quoted
from emberwatch.sources.readers import FAILURE
from emberwatch.sources.sinks import signal_rows
from emberwatch.sources.tables import spread, table

# Flat parts of a failure record; the same SQL runs in Spark and in the oracle.
_PARTS = {
    "info_code": "CASE WHEN event_type = 'error' THEN CASE CAST(user_id % 8 AS INT) WHEN 0 THEN '429' WHEN 1 THEN '401' "
                 "WHEN 2 THEN '402' WHEN 3 THEN '403' WHEN 4 THEN '500' WHEN 5 THEN '499' WHEN 6 THEN '0503' ELSE '' END "
                 "WHEN event_type = 'signup' THEN '' ELSE NULL END",
    "info_class": "CASE WHEN event_type = 'error' THEN concat('Failure', CAST(user_id % 3 AS VARCHAR(20))) ELSE NULL END",
    "info_provider": "CASE WHEN user_id % 4 = 0 THEN 'north' WHEN user_id % 4 = 1 THEN '' ELSE NULL END",
    "info_text": "CASE WHEN event_id % 3 = 0 THEN repeat('failed ', CAST(event_id % 60 AS INT)) ELSE '' END",
    "info_model": "CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 5 = 1 THEN NULL ELSE concat('m', CAST(user_id % 5 AS VARCHAR(20))) END",
    "model": "CASE WHEN user_id % 10 < 5 THEN NULL ELSE concat('n', CAST(user_id % 2 AS VARCHAR(20))) END",
    "exc_status": "CASE event_type WHEN 'click' THEN '503' WHEN 'view' THEN '404' WHEN 'signup' THEN '0' ELSE NULL END",
    "exc_provider": "CASE WHEN user_id % 3 = 0 THEN 'south' ELSE NULL END",
    "exc_class": "CASE WHEN event_type IN ('purchase', 'signup') THEN CASE CAST(event_id % 9 AS INT) "
                 + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(CLASS_LABELS))
                 + " WHEN 7 THEN 'ValueError' ELSE NULL END ELSE NULL END",
    "exc_text": "CASE WHEN event_id % 2 = 0 THEN concat('  error 401 for user ', CAST(user_id AS VARCHAR(20)), '  ') ELSE NULL END",
}


def raw_failures(spark, sf):
    """Nested failure records, as S2 reads them."""
    return nested(spread(table(spark, sf, "events", "event_id", "ts", "user_id", "event_type"), "event_id"))


def nested(events):
    """Failure records of event rows, from a table or a stream."""
    parts = events.selectExpr(
        "event_id", "ts", *[f"{sql} AS {name}" for name, sql in _PARTS.items()]
    )
    info = F.struct(F.col("info_code").alias("error_code"), F.col("info_class").alias("error_class"),
                    F.col("info_provider").alias("llm_provider"))
    slo = F.struct(info.alias("error_information"), F.col("info_text").alias("error_str"), F.col("info_model").alias("model"))
    exc = F.struct(F.col("exc_status").alias("status_code"), F.col("exc_provider").alias("llm_provider"),
                   F.col("exc_class").alias("cls"), F.col("exc_text").alias("text"))
    return parts.select("event_id", "ts", "model", slo.alias("slo"), exc.alias("exc"))


def _flat(spark, sf):
    return normalise_failures(raw_failures(spark, sf)).withColumn("at_us", micros("ts"))


def _classified(spark, sf):
    return classify(_flat(spark, sf))


_FLAT = f"""parts AS (SELECT event_id, epoch_us(ts) AS at_us, {', '.join(f'{sql} AS {name}' for name, sql in _PARTS.items())} FROM events),
flat AS (SELECT event_id, at_us,
 CASE WHEN info_code NOT IN ('', '0') THEN info_code WHEN exc_status NOT IN ('', '0') THEN exc_status ELSE '' END AS error_code,
 coalesce(nullif(info_class, ''), exc_class, '') AS error_class,
 coalesce(nullif(info_provider, ''), exc_provider, '') AS provider,
 coalesce(nullif(info_text, ''), exc_text, '') AS error_str,
 coalesce(nullif(info_model, ''), nullif(model, ''), 'unknown') AS model, exc_class AS exception_class FROM parts)"""
_CLASS_CASE = " ".join(f"WHEN exception_class = '{n}' THEN {quoted(label)}" for n, label in CLASS_LABELS)
_CLASSIFIED = _FLAT + f""",
classified AS (SELECT *, error_class || ':' || error_code || ':' || model AS fingerprint, CASE
 {' '.join(f"WHEN error_code = '{c}' THEN {quoted(label)}" for c, label in CODE_LABELS.items())}
 WHEN regexp_full_match(error_code, '[0-9]+') AND TRY_CAST(error_code AS BIGINT) >= 500 THEN '💥 Provider Error (' || error_code || ')'
 {_CLASS_CASE} END AS label FROM flat)"""


def thinned_sql(source: str, key: str, hold_us: int, at: str = "at_us") -> str:
    """Recursive CTE ``kept(key, at)``: greedy thinning by the next time at or after the hold."""
    return (
        f"kept(k, t) AS (SELECT {key}, min({at}) FROM {source} GROUP BY {key} UNION ALL "
        f"SELECT k, min({at}) FROM kept JOIN {source} ON {key} = k AND {at} >= t + {hold_us} GROUP BY k)"
    )


def e1(spark, sf):
    return _flat(spark, sf).drop("ts")


_MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def s2(spark, sf):
    """Failures as JSON text, read back with the source's schema."""
    as_json = raw_failures(spark, sf).select(F.to_json(F.struct("*"), _MICROS).alias("line"))
    parsed = as_json.select(F.from_json("line", FAILURE).alias("r")).select("r.*")
    return normalise_failures(parsed).withColumn("at_us", micros("ts")).drop("ts")


def _labels(column):
    def query(spark, sf):
        return _classified(spark, sf).select("event_id", column)

    return query, f"WITH {_CLASSIFIED} SELECT event_id, {column} FROM classified"


def e3(spark, sf):
    """Labels by class alone, with one class deriving from a listed one."""
    by_class = _flat(spark, sf).withColumn("error_code", F.lit(""))
    return classify(by_class, {"ValueError": ["BadGatewayError"]}).select("event_id", "label")


E3_SQL = f"""WITH {_FLAT} SELECT event_id, CASE {_CLASS_CASE} WHEN exception_class = 'ValueError'
THEN {quoted(CLASS_LABELS[-1][1])} END AS label FROM flat"""


def e4(spark, sf):
    return alertable(_classified(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


def _cooldown(seconds, points=True):
    def query(spark, sf):
        thinned = alert_points if points else alerts
        return thinned(_classified(spark, sf), cooldown_seconds=seconds).select("event_id", "at_us", "fingerprint")

    sql = f"""WITH RECURSIVE {_CLASSIFIED}, live AS (SELECT * FROM classified WHERE label IS NOT NULL),
{thinned_sql('live', 'fingerprint', seconds * 1_000_000)}
SELECT min(event_id) AS event_id, at_us, fingerprint FROM live JOIN kept ON fingerprint = k AND at_us = t GROUP BY at_us, fingerprint"""
    return query, sql


# An hour and 12 events suit how dense the test events are; the defaults are in ``operators.alerts``.
WINDOW, REARM = 3600, 1800


def _bursts(spark, sf, threshold):
    return burst_counts(_classified(spark, sf), window_seconds=WINDOW, threshold=threshold)


def e7(spark, sf):
    return _bursts(spark, sf, 12).select("event_id", "window_count")


COUNTED = f"""{_CLASSIFIED},
counted AS (SELECT event_id, at_us, error_class, error_code, count(*) OVER (ORDER BY at_us RANGE BETWEEN {WINDOW * 1_000_000} PRECEDING AND CURRENT ROW)
 - count(*) OVER (PARTITION BY at_us) + row_number() OVER (PARTITION BY at_us ORDER BY event_id) AS window_count
 FROM classified WHERE label IS NOT NULL)"""


def e8(spark, sf):
    return _bursts(spark, sf, 6).select("event_id", "is_burst")


def _signals(spark, sf):
    return burst_signals(_bursts(spark, sf, 12), rearm_seconds=REARM)


def e9(spark, sf):
    return _signals(spark, sf)


_EPISODES = f"""{COUNTED},
flagged AS (SELECT *, lag(at_us) OVER (ORDER BY at_us, event_id) AS before FROM counted WHERE window_count >= 12),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR at_us - before > {REARM * 1_000_000} THEN 1 ELSE 0 END)
 OVER (ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM flagged),
signals AS (SELECT min(at_us) AS started_at, arg_min(event_id, (at_us, event_id)) AS event_id,
 arg_min(error_class || ' (' || error_code || ')', (at_us, event_id)) AS reason,
 arg_min(window_count, (at_us, event_id)) AS burst_count, count(*) AS n_events, max(at_us) AS ended_at FROM numbered GROUP BY episode)"""


def s8(spark, sf):
    return signal_rows(_signals(spark, sf), WINDOW).withColumn("timestamp", F.col("timestamp").cast("bigint"))


def p9(spark, sf):
    rows = signal_rows(_signals(spark, sf), WINDOW)
    damaged = F.col("count") % 2 == 0
    reason = F.when(~damaged, F.col("reason"))
    count = F.when(~damaged, F.col("count"))
    return rows.select("signal_id", stop_notice(reason, count, F.col("window_sec")).alias("notice"))


P9_SQL = f"""WITH {_EPISODES} SELECT started_at || '-' || event_id AS signal_id, '<b>Reason:</b> '
|| CASE WHEN burst_count % 2 = 0 THEN 'unknown' ELSE reason END || chr(10) || '<b>Burst:</b> '
|| CASE WHEN burst_count % 2 = 0 THEN '?' ELSE CAST(burst_count AS VARCHAR) END || ' errors in {WINDOW}s' AS notice FROM signals"""

_STRIPPED = "trim(error_str[:300])"


def e10(spark, sf):
    return _flat(spark, sf).select("event_id", excerpt(F.col("error_str")).alias("excerpt"))


_EXCERPT = f"CASE WHEN length(error_str) > 300 THEN {_STRIPPED} || '…' ELSE {_STRIPPED} END"


def e11(spark, sf):
    live = alertable(_classified(spark, sf))
    text = body(F.col("label"), F.col("model"), F.col("provider"), F.col("error_class"), excerpt(F.col("error_str")))
    return live.select("event_id", text.alias("body"))


E11_SQL = f"""WITH {_CLASSIFIED} SELECT event_id, '<b>' || label || '</b>' || chr(10) || '<b>Model:</b> <code>' || model || '</code>'
|| CASE WHEN provider <> '' THEN chr(10) || '<b>Provider:</b> ' || provider ELSE '' END
|| CASE WHEN error_class <> '' THEN chr(10) || '<b>Class:</b> ' || error_class ELSE '' END
|| CASE WHEN {_EXCERPT} <> '' THEN chr(10) || chr(10) || '<pre>' || {_EXCERPT} || '</pre>' ELSE '' END AS body
FROM classified WHERE label IS NOT NULL"""


def e12(spark, sf):
    raw = raw_failures(spark, sf)
    status = F.col("exc.status_code").try_cast("int")
    return raw.select("event_id", is_auth_failure(status, F.col("exc.text")).alias("auth_failure"))


E12_SQL = f"""WITH {_FLAT} SELECT event_id, coalesce(TRY_CAST(exc_status AS INT) = 401, FALSE)
OR coalesce(contains(exc_text, '401'), FALSE) AS auth_failure FROM parts"""

_FLAT_SELECT = f"WITH {_FLAT} SELECT event_id, at_us, error_code, error_class, provider, error_str, model, exception_class FROM flat"

QUERIES = {
    "S2_failure_source": (s2, _FLAT_SELECT),
    "S8_signal_rows": (s8, f"WITH {_EPISODES} SELECT reason, burst_count AS count, {WINDOW} AS window_sec, "
                           "started_at // 1000000 AS timestamp, started_at || '-' || event_id AS signal_id FROM signals"),
    "E1_normalise": (e1, _FLAT_SELECT),
    "E2_classify": _labels("label"),
    "E3_classify_by_class": (e3, E3_SQL),
    "E4_alertable": (e4, f"WITH {_CLASSIFIED} SELECT label, count(*) AS n FROM classified WHERE label IS NOT NULL GROUP BY label"),
    "E5_fingerprint": _labels("fingerprint"),
    "E6_cooldown": _cooldown(60),
    "E6_long_cooldown": _cooldown(6 * 3600, points=False),
    "E7_window_count": (e7, f"WITH {COUNTED} SELECT event_id, window_count FROM counted"),
    "E8_burst_flag": (e8, f"WITH {COUNTED} SELECT event_id, window_count >= 6 AS is_burst FROM counted"),
    "E9_burst_episodes": (e9, f"WITH {_EPISODES} SELECT started_at, event_id, reason, burst_count, n_events, ended_at FROM signals"),
    "E10_excerpt": (e10, f"WITH {_FLAT} SELECT event_id, {_EXCERPT} AS excerpt FROM flat"),
    "E11_alert_body": (e11, E11_SQL),
    "E12_auth_failures": (e12, E12_SQL),
    "P9_stop_notice": (p9, P9_SQL),
}
