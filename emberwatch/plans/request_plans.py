"""Queries and oracles of request enrichment and command audit (S6, R1-R14), on ``events`` and dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions.text import SECOND, micros
from emberwatch.operators.commands import (
    allow_list, authorised, confirmations, next_offset, parse_updates, unauthorised,
)
from emberwatch.operators.requests import (
    correct_endpoints, credential_state, credentials_in_force, in_family, inject_headers, issued_headers,
    refresh_points, renewals, resolve_aliases,
)
from emberwatch.sources.readers import aliases as read_aliases
from emberwatch.sources.readers import catalog as read_catalog
from emberwatch.sources.tables import table

FAMILY = "house/"

# Requests name catalog models, aliases and models of others.
_MODEL = """CASE CAST(event_id % 3 AS INT) WHEN 0 THEN concat('house/m', CAST(user_id % 30 AS VARCHAR(20)))
WHEN 1 THEN concat('alias-', CAST(user_id % 120 AS VARCHAR(20))) ELSE concat('other/m', CAST(user_id % 30 AS VARCHAR(20))) END"""
_BASE = """CASE CAST(event_id % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://wrong.example/v1'
ELSE concat('https://r', CAST(user_id % 5 AS VARCHAR(20)), '.example/v1') END"""
_CATALOG = {
    "model_name": "concat('house/m', CAST(n_nationkey AS VARCHAR(20)))",
    "api_base": "CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE concat('https://r', CAST(n_regionkey AS VARCHAR(20)), '.example/v1') END",
}
_ALIASES = {
    "alias": "concat('alias-', CAST(s_suppkey AS VARCHAR(20)))",
    "target": """CASE WHEN s_suppkey % 4 = 0 THEN concat('{"model":"house/m', CAST(s_nationkey AS VARCHAR(20)), '"}')
WHEN s_suppkey % 4 = 1 THEN concat('other/m', CAST(s_nationkey AS VARCHAR(20))) ELSE concat('house/m', CAST(s_nationkey AS VARCHAR(20))) END""",
}
_ALIAS_TARGET = "CASE WHEN s_suppkey % 4 = 1 THEN 'other/m' ELSE 'house/m' END || s_nationkey"


def _requests(spark, sf):
    events = table(spark, sf, "events", "event_id", "ts", "user_id")
    return events.select(
        F.col("event_id").alias("request_id"), micros("ts").alias("at_us"), "user_id",
        F.expr(_MODEL).alias("model"), F.expr(_BASE).alias("api_base"),
    )


_REQUESTS = f"requests AS (SELECT event_id AS request_id, epoch_us(ts) AS at_us, user_id, {_MODEL} AS model, {_BASE} AS api_base FROM events)"


def _catalog(spark, sf):
    rows = table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    return read_catalog(rows.selectExpr(*[f"{sql} AS {name}" for name, sql in _CATALOG.items()]))


def _aliases(spark, sf):
    rows = table(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    return read_aliases(rows.selectExpr(*[f"{sql} AS {name}" for name, sql in _ALIASES.items()]))


def s6(spark, sf):
    return _aliases(spark, sf).unionByName(
        _catalog(spark, sf).select(F.col("model_name").alias("alias"), F.col("api_base").alias("target"))
    )


S6_SQL = f"""SELECT 'alias-' || s_suppkey AS alias, {_ALIAS_TARGET} AS target FROM supplier
UNION ALL SELECT 'house/m' || n_nationkey, 'https://r' || n_regionkey || '.example/v1' FROM nation WHERE n_nationkey % 6 <> 0"""


def _resolved(spark, sf):
    return resolve_aliases(_requests(spark, sf), _aliases(spark, sf))


def r1(spark, sf):
    return _resolved(spark, sf).select("request_id", "resolved_model")


_RESOLVED = f"""{_REQUESTS}, aliases AS (SELECT 'alias-' || s_suppkey AS alias, {_ALIAS_TARGET} AS target FROM supplier),
resolved AS (SELECT r.*, coalesce(target, model) AS resolved_model FROM requests r LEFT JOIN aliases ON alias = model)"""


def r2(spark, sf):
    rows = _resolved(spark, sf)
    return rows.select("request_id", in_family(F.col("model"), F.col("resolved_model"), FAMILY).alias("in_family"))


def r3(spark, sf):
    return correct_endpoints(_requests(spark, sf), _catalog(spark, sf)).select("request_id", "api_base", "corrected")


R3_SQL = f"""WITH {_REQUESTS}, catalog AS (SELECT 'house/m' || n_nationkey AS model_name, 'https://r' || n_regionkey || '.example/v1' AS base
FROM nation WHERE n_nationkey % 6 <> 0)
SELECT request_id, CASE WHEN api_base <> '' AND api_base <> base THEN base ELSE api_base END AS api_base,
coalesce(api_base <> '' AND api_base <> base, FALSE) AS corrected FROM requests LEFT JOIN catalog ON model_name = model"""


# Lists that name a model or an alias again and again, some without a base; the last entry counts.
_REPEATED = [
    "concat('house/m', CAST(s_nationkey AS VARCHAR(20))) AS model_name",
    "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('https://s', CAST((s_suppkey * 7) % 10 AS VARCHAR(20)), '.example/v1') END AS api_base",
]
_REPEATED_ALIAS = [
    "concat('alias-', CAST(s_suppkey % 40 AS VARCHAR(20))) AS alias", "concat('house/m', CAST((s_suppkey * 13) % 25 AS VARCHAR(20))) AS target",
]


def r3_repeated(spark, sf):
    listed = table(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    models = read_catalog(listed.selectExpr(*_REPEATED, "s_suppkey AS pos"))
    return correct_endpoints(_requests(spark, sf), models).select("request_id", "api_base", "corrected")


R3_REPEATED_SQL = f"""WITH {_REQUESTS}, listed AS (SELECT {', '.join(_REPEATED)}, s_suppkey FROM supplier),
catalog AS (SELECT model_name, arg_max(api_base, s_suppkey) AS base FROM listed WHERE api_base IS NOT NULL GROUP BY model_name)
SELECT request_id, CASE WHEN api_base <> '' AND api_base <> base THEN base ELSE api_base END AS api_base,
coalesce(api_base <> '' AND api_base <> base, FALSE) AS corrected FROM requests LEFT JOIN catalog ON model_name = model"""


def r1_repeated(spark, sf):
    listed = table(spark, sf, "supplier", "s_suppkey")
    names = read_aliases(listed.selectExpr(*_REPEATED_ALIAS, "s_suppkey AS pos"))
    return resolve_aliases(_requests(spark, sf), names).select("request_id", "resolved_model")


R1_REPEATED_SQL = f"""WITH {_REQUESTS}, aliases AS (SELECT alias, arg_max(target, s_suppkey) AS target FROM (SELECT {', '.join(_REPEATED_ALIAS)}, s_suppkey FROM supplier) GROUP BY alias)
SELECT request_id, coalesce(target, model) AS resolved_model FROM requests LEFT JOIN aliases ON alias = model"""


def r4(spark, sf):
    events = table(spark, sf, "events", "event_id", "user_id", "event_type")
    issued = F.create_map(
        F.lit("x-api-key"), F.lit("k"), F.lit("x-user"), F.col("user_id").cast("string"), F.lit("x-kind"), F.col("event_type")
    )
    token = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    own = F.when(F.col("event_id") % 3 > 0, F.create_map(F.lit("x-kind"), F.lit("own"), F.lit("x-trace"), F.col("event_id").cast("string")))
    merged = inject_headers(own, issued_headers(issued, token))
    text = F.array_join(F.sort_array(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return events.select("event_id", text.alias("headers"))


R4_SQL = """SELECT event_id, 'Authorization=Bearer sha256:' || sha256('t' || user_id)
|| ';x-kind=' || event_type || CASE WHEN event_id % 3 > 0 THEN ';x-trace=' || event_id ELSE '' END || ';x-user=' || user_id AS headers FROM events"""

# Credentials are issued by signups, for one of six providers; the TTL depends on the user.
_PROVIDER = "user_id % 6"


def _provider_requests(spark, sf):
    return _requests(spark, sf).withColumn("provider", F.expr(_PROVIDER))


def _credentials(spark, sf):
    signups = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type").filter("event_type = 'signup'")
    issued = micros("ts")
    return signups.select(
        F.expr(_PROVIDER).alias("provider"), issued.alias("issued_at"),
        (issued + (F.col("user_id") % 10 + 1) * (600 * SECOND)).alias("expires_at"), F.col("event_id").alias("credential_id"),
    )


def _in_force(spark, sf):
    return credentials_in_force(_provider_requests(spark, sf), _credentials(spark, sf), ["provider"], block_us=86400 * SECOND, order="credential_id")


def r5(spark, sf):
    return _in_force(spark, sf).select("request_id", F.col("credential.credential_id").alias("credential_id"))


_IN_FORCE = f"""{_REQUESTS},
creds AS (SELECT {_PROVIDER} AS provider, epoch_us(ts) AS issued_at, epoch_us(ts) + (user_id % 10 + 1) * 600000000 AS expires_at,
 event_id AS credential_id FROM events WHERE event_type = 'signup'),
forced AS (SELECT r.request_id, r.at_us, c.credential_id, c.expires_at FROM (SELECT *, {_PROVIDER} AS provider FROM requests) r
 ASOF LEFT JOIN creds c ON r.provider = c.provider AND r.at_us >= c.issued_at)"""


def r6(spark, sf):
    state = credential_state(F.col("at_us"), F.col("credential.expires_at"))
    return _in_force(spark, sf).select("request_id", state.alias("state"))


R6_SQL = f"""WITH {_IN_FORCE} SELECT request_id, CASE WHEN at_us < expires_at - 300000000 THEN 'fresh'
WHEN at_us < expires_at THEN 'due' ELSE 'expired' END AS state FROM forced"""

TTL = 4 * 3600 * SECOND


def _auth_failures(spark, sf):
    errors = table(spark, sf, "events", "ts", "user_id", "event_type", "value").filter("event_type = 'error' AND value > 60")
    return errors.select(F.expr(_PROVIDER).alias("provider"), micros("ts").alias("at_us"))


def _good_requests(spark, sf):
    events = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type").filter("event_type <> 'error'")
    return events.select(F.col("event_id").alias("request_id"), F.expr(_PROVIDER).alias("provider"), micros("ts").alias("at_us"))


def _refresh(with_resets):
    def query(spark, sf):
        resets = _auth_failures(spark, sf) if with_resets else None
        return refresh_points(_good_requests(spark, sf), resets, ["provider"], TTL).select("request_id", "provider", "at_us")

    hold = TTL - 300 * SECOND
    # Walks requests and resets in order: ``free`` is when the next request renews.
    sql = f"""WITH RECURSIVE marks AS (SELECT event_id, {_PROVIDER} AS provider, epoch_us(ts) AS at_us, event_type = 'error' AS is_reset FROM events
  WHERE event_type <> 'error' OR ({'value > 60' if with_resets else 'FALSE'})),
ordered AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY at_us, is_reset, event_id) AS n FROM marks),
walk(provider, n, request_id, at_us, renews, free) AS (
 SELECT DISTINCT provider, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, CAST(0 AS BIGINT) FROM ordered
 UNION ALL SELECT o.provider, o.n, o.event_id, o.at_us, NOT o.is_reset AND o.at_us >= w.free,
  CASE WHEN o.is_reset THEN least(w.free, o.at_us + 1) WHEN o.at_us >= w.free THEN o.at_us + {hold} ELSE w.free END
 FROM walk w JOIN ordered o ON o.provider = w.provider AND o.n = w.n + 1)
SELECT request_id, provider, at_us FROM walk WHERE renews"""
    return query, sql


# A credential lives for half an hour to five hours, and every third attempt to renew one fails.
_LIFE = "(user_id % 10 + 1) * 1800000000"
_SUCCEEDS = "event_id % 3 > 0"


def r9(spark, sf):
    events = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type").filter("event_type <> 'error'")
    requests = events.select(
        F.col("event_id").alias("request_id"), F.expr(_PROVIDER).alias("provider"), micros("ts").alias("at_us"), F.expr(_LIFE).alias("life"),
        F.expr(_SUCCEEDS).alias("good"),
    )
    judged = renewals(requests, _auth_failures(spark, sf), ["provider"], F.col("life"), 5 * 3600 * SECOND, F.col("good"))
    return judged.select("request_id", "outcome")


# Walks requests and invalidations in order with the expiry of the credential in hand.
R9_SQL = f"""WITH RECURSIVE marks AS (SELECT event_id, {_PROVIDER} AS provider, epoch_us(ts) AS at_us, event_type = 'error' AS is_reset,
  {_LIFE} AS life, {_SUCCEEDS} AS good FROM events WHERE event_type <> 'error' OR value > 60),
ordered AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY at_us, is_reset, event_id) AS n FROM marks),
walk(provider, n, request_id, outcome, expires) AS (
 SELECT DISTINCT provider, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM ordered
 UNION ALL SELECT o.provider, o.n, o.event_id, CASE WHEN o.is_reset THEN NULL WHEN o.at_us < w.expires - 300000000 THEN 'cached' WHEN o.good THEN 'refreshed'
   WHEN o.at_us < w.expires THEN 'stale-ok' ELSE 'error' END,
  CASE WHEN o.is_reset THEN 0 WHEN o.at_us < w.expires - 300000000 OR NOT o.good THEN w.expires ELSE o.at_us + o.life END
 FROM walk w JOIN ordered o ON o.provider = w.provider AND o.n = w.n + 1)
SELECT request_id, outcome FROM walk WHERE outcome IS NOT NULL"""

# Chat updates: buttons, messages, edited messages and others, as JSON.
_UPDATE = """CASE CAST(event_id % 7 AS INT)
WHEN 0 THEN concat('{"callback_query":{"id":"1","from":{"id":', CAST(user_id AS VARCHAR(20)), '},"message":{"chat":{"id":', CAST(user_id % 9 AS VARCHAR(20)), '}},"data":"confirm:stop"}}')
WHEN 1 THEN concat('{"callback_query":{"id":"1","from":{"id":', CAST(user_id AS VARCHAR(20)), '},"message":{"chat":{"id":', CAST(user_id % 9 AS VARCHAR(20)), '}},"data":"action:', CASE WHEN event_id % 2 = 0 THEN 'stop' ELSE 'restart' END, '"}}')
WHEN 2 THEN concat('{"callback_query":{"id":"1","from":{"id":', CAST(user_id AS VARCHAR(20)), '},"message":{"chat":{"id":', CAST(user_id % 9 AS VARCHAR(20)), '}},"data":"confirm:restart:now"}}')
WHEN 3 THEN concat('{"message":{"from":{"id":', CAST(user_id AS VARCHAR(20)), '},"chat":{"id":', CAST(user_id % 9 AS VARCHAR(20)), '},"text":"/status"}}')
WHEN 4 THEN concat('{"edited_message":{"from":{"id":', CAST(user_id AS VARCHAR(20)), '},"chat":{"id":', CAST(user_id % 9 AS VARCHAR(20)), '},"text":"/menu"}}')
WHEN 5 THEN concat('{"message":{"from":{"id":', CAST(user_id AS VARCHAR(20)), '},"text":"hello"}}') ELSE '{"poll":{}}' END"""


def _commands(spark, sf):
    events = table(spark, sf, "events", "event_id", "user_id")
    updates = events.select(F.col("event_id").alias("update_id"), F.expr(_UPDATE).alias("payload"))
    return parse_updates(updates).drop("payload")


_COMMANDS = """commands AS (SELECT event_id AS update_id, user_id, user_id % 9 AS chat_id,
CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'confirm' WHEN 1 THEN 'action' WHEN 2 THEN 'confirm' ELSE 'command' END AS kind,
CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'stop' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'stop' ELSE 'restart' END
WHEN 2 THEN 'restart:now' WHEN 3 THEN '/status' ELSE '/menu' END AS action FROM events WHERE event_id % 7 < 5)"""

_LIST = """CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN concat(' ', CAST(c_custkey AS VARCHAR(20)), ' ,x,', CAST(c_custkey AS VARCHAR(20)))
WHEN 1 THEN concat('-', CAST(c_custkey AS VARCHAR(20)), ',--7,') WHEN 2 THEN '' WHEN 3 THEN '1a, 2 3' ELSE concat('9,', CAST(c_custkey AS VARCHAR(20)), '') END"""


def r11(spark, sf):
    lists = table(spark, sf, "customer", "c_custkey").select("c_custkey", F.expr(_LIST).alias("text"))
    return lists.select("c_custkey", F.explode(allow_list(F.col("text"))).alias("user_id"))


R11_SQL = f"""SELECT DISTINCT c_custkey, CAST(trim(entry) AS BIGINT) AS user_id FROM (SELECT c_custkey, unnest(string_split({_LIST}, ',')) AS entry FROM customer)
WHERE regexp_full_match(trim(entry), '-?[0-9]+')"""


def _allowed(spark, sf):
    funded = table(spark, sf, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 3000")
    return funded.select(F.col("c_custkey").alias("user_id"))


def r10(spark, sf):
    commands, allowed = _commands(spark, sf), _allowed(spark, sf)
    yes = authorised(commands, allowed).withColumn("allowed", F.lit(True))
    return yes.unionByName(unauthorised(commands, allowed).withColumn("allowed", F.lit(False))).select("update_id", "allowed")


R10_SQL = f"""WITH {_COMMANDS} SELECT update_id, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) AS allowed FROM commands"""


def r12(spark, sf):
    return _commands(spark, sf)


def r13(spark, sf):
    return confirmations(_commands(spark, sf), block=500).select("update_id", "chat_id", "action", "confirmed")


R13_SQL = f"""WITH {_COMMANDS}, steps AS (SELECT *, lag(kind) OVER w AS before_kind, lag(action) OVER w AS before_action FROM commands
WHERE kind = 'confirm' OR kind = 'action' WINDOW w AS (PARTITION BY chat_id ORDER BY update_id))
SELECT update_id, chat_id, action, coalesce(before_kind = 'confirm' AND before_action = action, FALSE) AS confirmed FROM steps WHERE kind = 'action'"""


def r14(spark, sf):
    return next_offset(table(spark, sf, "events", "event_id").select(F.col("event_id").alias("update_id")))


QUERIES = {
    "S6_catalog_and_aliases": (s6, S6_SQL),
    "R1_aliases": (r1, f"WITH {_RESOLVED} SELECT request_id, resolved_model FROM resolved"),
    "R1_repeated_aliases": (r1_repeated, R1_REPEATED_SQL),
    "R3_repeated_models": (r3_repeated, R3_REPEATED_SQL),
    "R2_provider_family": (r2, f"WITH {_RESOLVED} SELECT request_id, starts_with(model, '{FAMILY}') OR starts_with(resolved_model, '{FAMILY}') AS in_family FROM resolved"),
    "R3_endpoints": (r3, R3_SQL),
    "R4_headers": (r4, R4_SQL),
    "R5_credential_in_force": (r5, f"WITH {_IN_FORCE} SELECT request_id, credential_id FROM forced"),
    "R6_credential_state": (r6, R6_SQL),
    "R7_refresh_points": _refresh(False),
    "R8_refresh_after_invalidation": _refresh(True),
    "R9_refresh_outcome": (r9, R9_SQL),
    "R10_authorisation": (r10, R10_SQL),
    "R11_allow_list": (r11, R11_SQL),
    "R12_commands": (r12, f"WITH {_COMMANDS} SELECT update_id, user_id, chat_id, kind, action FROM commands"),
    "R13_confirmations": (r13, R13_SQL),
    "R14_next_offset": (r14, "SELECT max(event_id) + 1 AS next_offset FROM events"),
}
