"""Boundaries of alerting, health, requests and commands, each on a few rows."""

import json

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.text import SECOND, micros
from emberwatch.operators import alerts as A
from emberwatch.operators.commands import allow_list, authorised, confirmations, parse_updates, unauthorised
from emberwatch.operators.health import gate, restart_events
from emberwatch.operators.processes import high_memory, restarts, status_line, stop_notice
from emberwatch.operators.requests import (
    correct_endpoints, credential_state, inject_headers, issued_headers, refresh_outcome, refresh_points,
)
from emberwatch.operators.secrets import decision, normalise, redact
from emberwatch.sources.readers import (
    FAILURE, env_lines, env_settings, failures, health_status, process_snapshots, snippets_from_files, snippets_from_json,
)
from emberwatch.sources.sinks import write_reports, write_signals


def at(seconds):
    return 1_700_000_000_000_000 + int(seconds * SECOND)


def one(spark, column, **values):
    literals = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(column(**literals).alias("x")).first().x


@pytest.mark.parametrize("code, label", [
    ("429", "🚦 Rate Limit"), ("401", "🔑 Auth Failure"), ("402", "💳 Quota Exceeded"), ("403", "🔒 Permission Denied"),
    ("404", None), ("499", None), ("500", "💥 Provider Error (500)"), ("599", "💥 Provider Error (599)"),
    ("0500", "💥 Provider Error (0500)"), ("99999999999999999999", "💥 Provider Error (99999999999999999999)"), ("5xx", None), ("", None),
])
def test_code_labels(spark, code, label):
    assert one(spark, lambda code: A.code_label(code), code=code) == label


def test_failures_from_json(spark, tmp_path):
    rows = [
        {"event_id": 1, "ts": "2024-01-01T00:00:00", "slo": {"error_information": {"error_code": 429}, "model": "m"}},
        {"event_id": 2, "ts": "2024-01-01T00:00:01", "slo": {"error_information": {"error_code": ""}}, "exc": {"status_code": 503, "cls": "X"}},
        {"event_id": 3, "ts": "2024-01-01T00:00:02", "model": "n", "exc": {"status_code": 0, "cls": "BudgetExceededError", "text": "t"}},
        {"event_id": 4, "ts": "2024-01-01T00:00:03"},
    ]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, rows)))
    flat = A.classify(A.normalise_failures(failures(spark, str(tmp_path)))).orderBy("event_id").collect()
    assert [(r.error_code, r.error_class, r.model) for r in flat] == [
        ("429", "", "m"), ("503", "X", "unknown"), ("", "BudgetExceededError", "n"), ("", "", "unknown")
    ]
    assert [r.label for r in flat] == ["🚦 Rate Limit", "💥 Provider Error (503)", "💳 Budget Exceeded", None]
    assert flat[0].fingerprint == ":429:m" and flat[2].error_str == "t"
    assert FAILURE


def test_subclass_takes_label_of_its_base(spark):
    bases = {"Slow": ["ServiceUnavailableError"], "Both": ["BadGatewayError", "RateLimitError"]}
    for name, label in [("Slow", "⚠️ Provider 503"), ("Both", "🚦 Rate Limit"), ("Other", None)]:
        assert one(spark, lambda c: A.class_label(c, bases), c=name) == label


@pytest.mark.parametrize("n, ends", [(299, False), (300, False), (301, True)])
def test_excerpt_length(spark, n, ends):
    text = one(spark, lambda t: A.excerpt(t), t="  " + "x" * (n - 2))
    assert text == "x" * (min(n, 300) - 2) + ("…" if ends else "")


def test_burst_boundaries(spark):
    rows = [(i, at(i), "429", None) for i in range(10)] + [(10, at(10.0), "404", None), (11, at(10.0), "500", None), (12, at(10.0), "500", None)]
    df = A.classify(spark.createDataFrame(rows, "event_id bigint, at_us bigint, error_code string, exception_class string")
                    .withColumn("error_class", F.lit("E")).withColumn("model", F.lit("m")))
    got = {r.event_id: (r.window_count, r.is_burst) for r in A.burst_counts(df).collect()}
    assert got[8] == (9, False) and got[9] == (10, True)
    assert got[11] == (11, True) and got[12] == (12, True) and 10 not in got
    signal = A.burst_signals(A.burst_counts(df)).collect()
    assert [(s.event_id, s.reason, s.burst_count, s.n_events) for s in signal] == [(9, "E (429)", 10, 3)]


def test_restart_detection(spark):
    rows = [(i, at(i), n) for i, n in enumerate([0, 1, 3, 4, 4, 2, 5])]
    df = spark.createDataFrame(rows, "snapshot_id bigint, at_us bigint, restarts bigint").withColumn("name", F.lit("p"))
    assert sorted(r.snapshot_id for r in restarts(df, block_us=2 * SECOND).collect()) == [2, 3, 6]


def test_process_defaults_and_status(spark):
    payload = '[{"name":"a","restart_time":2,"monit":{"memory":2097152},"pm2_env":{"status":"online","restart_time":7}},{"pm2_env":{}}]'
    polls = spark.createDataFrame([(1, payload), (2, "no json")], "snapshot_id bigint, payload string")
    rows = process_snapshots(polls).orderBy("name").collect()
    assert [tuple(r)[1:] for r in rows] == [("?", 0, 0, "?"), ("a", 2, 2097152, "online")]
    env = process_snapshots(polls, counter="env")
    lines = env.select(status_line(F.col("name"), F.col("status"), F.col("restarts"), F.col("mem_bytes")).alias("l")).collect()
    assert sorted(r.l for r in lines) == ["🟡 <b>?</b> — ?, ↺0, ?", "🟢 <b>a</b> — online, ↺7, 2MB"]
    edge = spark.createDataFrame([(1024**3,), (1024**3 - 1,)], "mem_bytes bigint")
    assert high_memory(edge).count() == 1
    assert one(spark, lambda r: stop_notice(r, F.lit(None).cast("int"), F.lit(10)), r=None) == "<b>Reason:</b> unknown\n<b>Burst:</b> ? errors in 10s"


def test_health_answers(spark):
    for payload, status in [(None, None), ("{}", "unknown"), ('{"db":"connected"}', "connected"), ("{oops", None)]:
        assert one(spark, lambda p: health_status(p.cast("string")), p=payload) == status


def machine(spark, samples):
    rows = [("s", i, at(t), status) for i, (t, status) in enumerate(samples)]
    df = spark.createDataFrame(rows, "service string, sample_id bigint, at_us bigint, status string").repartition(4)
    events = restart_events(df).orderBy("at_us").collect()
    return [((r.at_us - at(0)) / SECOND, r.event, r.restarts) for r in events]


def test_restart_budget(spark):
    bad = "disconnected"
    assert machine(spark, [(t, bad) for t in (0, 15, 30, 45, 60)]) == [(60, "RESTART", 1)]
    assert machine(spark, [(t, bad) for t in (0, 15, 30, 45, 60.5)]) == []
    # Samples closer than 12 s do not count, failed fetches change nothing, healthy ones keep the failures.
    assert machine(spark, [(0, bad), (5, bad), (11, bad), (12, bad), (24, None), (36, "connected"), (48, bad), (60, bad)]) == []
    steady = [(t, bad) for t in range(0, 3000, 12)]
    assert machine(spark, steady) == [(48, "RESTART", 1), (216, "RESTART", 2), (384, "RESTART", 3), (552, "SHUTDOWN", 3)]
    ill = [(t, bad) for t in range(0, 60, 12)]
    for last, events in [(779, []), (780, [(780, "RECOVERED", 0)])]:
        assert machine(spark, [*ill, (180, "connected"), (last, "connected")])[1:] == events


def test_sample_gate(spark):
    df = spark.createDataFrame([(i, "s", at(t)) for i, t in enumerate([0, 11.9, 12, 23, 24])], "sample_id bigint, service string, at_us bigint")
    assert sorted(r.sample_id for r in gate(df).collect()) == [0, 2, 4]


def test_credential_state_and_outcome(spark):
    end = at(1000)
    for now, state in [(at(699), "fresh"), (at(700), "due"), (at(999), "due"), (at(1000), "expired")]:
        assert one(spark, lambda n, e: credential_state(n, e), n=now, e=end) == state
    assert one(spark, lambda e: credential_state(F.lit(1), e.cast("bigint")), e=None) == "expired"
    assert [one(spark, lambda ok, n, e: refresh_outcome(ok, n, e), ok=ok, n=now, e=end) for ok, now in [(True, 0), (False, at(1)), (False, end)]] == [
        "refreshed", "stale-ok", "error"]


def test_refresh_points(spark):
    ttl = 3600 * SECOND
    requests = spark.createDataFrame([(i, "p", at(t)) for i, t in enumerate([0, 100, 3299, 3300, 3400, 3500])], "request_id bigint, p string, at_us bigint")
    resets = spark.createDataFrame([("p", at(3450)), ("q", at(50))], "p string, at_us bigint")
    assert sorted(r.request_id for r in refresh_points(requests, resets, ["p"], ttl).collect()) == [0, 3, 5]


def test_endpoints_and_headers(spark):
    catalog = spark.createDataFrame([("m", "https://a"), ("n", None)], "model_name string, api_base string")
    rows = [(1, "m", None), (2, "m", "https://a"), (3, "m", "https://b"), (4, "x", "https://b"), (5, "n", "https://b"), (6, "m", "")]
    got = correct_endpoints(spark.createDataFrame(rows, "id int, model string, api_base string"), catalog).orderBy("id").collect()
    assert [(r.api_base, r.corrected) for r in got] == [
        (None, False), ("https://a", False), ("https://a", True), ("https://b", False), ("https://b", False), ("", False)]
    maps = spark.createDataFrame([({"x-api-key": "k", "a": "new"}, {"a": "old", "b": "1"}), ({"a": "new"}, None)], "h map<string,string>, own map<string,string>")
    merged = [r.m for r in maps.select(inject_headers(F.col("own"), issued_headers(F.col("h"), F.lit("t"))).alias("m")).collect()]
    assert {k: v for k, v in merged[0].items() if k != "Authorization"} == {"a": "new", "b": "1"}
    assert merged[1]["a"] == "new" and merged[1]["Authorization"].startswith("Bearer sha256:")


def test_commands(spark):
    def button(data, user=5):
        return {"callback_query": {"id": "1", "from": {"id": user}, "message": {"chat": {"id": 1}}, "data": data}}

    updates = [button("confirm:stop"), button("action:stop"), button("action:stop"), button("confirm:a:b"), button("action:restart"),
               {"edited_message": {"from": {"id": -5}, "chat": {"id": 2}, "text": "/x"}}, {"message": {"text": "hi"}}, {"poll": {}}, {"message": {"text": "/y"}}]
    df = spark.createDataFrame([(i, json.dumps(u)) for i, u in enumerate(updates)], "update_id bigint, payload string")
    parsed = parse_updates(df)
    assert [(r.update_id, r.user_id, r.kind, r.action) for r in parsed.orderBy("update_id").collect()] == [
        (0, 5, "confirm", "stop"), (1, 5, "action", "stop"), (2, 5, "action", "stop"), (3, 5, "confirm", "a:b"),
        (4, 5, "action", "restart"), (5, -5, "command", "/x"), (8, 0, "command", "/y")]
    assert [(r.update_id, r.confirmed) for r in confirmations(parsed, block=2).orderBy("update_id").collect()] == [(1, True), (2, False), (4, False)]
    allowed = spark.createDataFrame([("5, -5 ,x,--7,,5",)], "t string").select(F.explode(allow_list(F.col("t"))).alias("user_id"))
    assert sorted(r.user_id for r in allowed.collect()) == [-5, 5]
    assert authorised(parsed, allowed).count() == 6 and unauthorised(parsed, allowed).count() == 1


def test_settings(spark):
    lines = ["A=", " A = 1 ", "A=2", "#B=1", "C=x=y#z", "=n", "none", "D="]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "path string, line int, value string")
    pairs = env_lines(df)
    assert {r.key: r.value for r in env_settings(pairs).collect()} == {"A": "1", "C": "x=y#z", "D": ""}
    assert {r.key: r.value for r in env_settings(pairs, keep="last").collect()} == {"A": "2", "C": "x=y#z", "D": ""}


def test_secret_content(spark):
    zero = chr(0x200B)
    assert one(spark, lambda t: normalise(t), t=f"pass{zero}word%3A 73656372657420646174612121") == "password: 73656372657420646174612121\nsecret data!!"
    assert one(spark, lambda t: redact(t), t="a@b.example 10.0.0.1") == "[EMAIL] [IPV4]"
    assert [one(spark, lambda a, b: decision(a, b), a=a, b=b) for a, b in [(True, True), (False, True), (False, False)]] == ["BLOCK", "REDACT", "ALLOW"]


def test_files_in_and_out(spark, tmp_path):
    from emberwatch.operators.policy import Policy
    from emberwatch.operators.scan import scan

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("token = 1\nprint(token)\n")
    (tmp_path / "in" / "b.txt").write_text("not read")
    found = scan(snippets_from_files(spark, str(tmp_path / "in")), Policy())
    write_reports(found, str(tmp_path / "out"))
    assert [r.blocked for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [True]
    (tmp_path / "rows.json").write_text('{"snippet_id":"1","code":"echo ${#X}"}')
    assert [r.language for r in scan(snippets_from_json(spark, str(tmp_path / "rows.json")), Policy()).collect()] == ["bash"]
    signals = spark.createDataFrame([(at(0), 7, "E (429)", 10)], "started_at bigint, event_id bigint, reason string, burst_count bigint")
    write_signals(signals, 10, str(tmp_path / "signals"))
    row = spark.read.json(str(tmp_path / "signals")).first()
    assert (row.reason, row["count"], row.window_sec, row.timestamp) == ("E (429)", 10, 10, 1_700_000_000.0)


def test_micros_are_exact(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:07.179575' AS ts")
    assert df.select(micros("ts").alias("u")).first().u == 1704067207179575
