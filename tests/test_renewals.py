"""Renewals against a walk that issues, fails and invalidates one request at a time."""

import random

from pyspark.sql import functions as F

from emberwatch.operators.requests import credentials_in_force, renewals

SKEW = 300


def walked(requests, resets):
    out, expires = {}, {}
    marks = [(at, 0, i, k, life, good) for i, k, at, life, good in requests] + [(at, 1, 0, k, 0, False) for k, at in resets]
    for at, is_reset, i, k, life, good in sorted(marks, key=lambda m: m[:3]):
        until = expires.get(k, 0)
        if is_reset:
            expires[k] = 0
        elif at < until - SKEW:
            out[i] = "cached"
        elif good:
            out[i] = "refreshed"
            expires[k] = at + life
        else:
            out[i] = "stale-ok" if at < until else "error"
    return out


def test_outcomes_equal_a_walk(spark):
    rng = random.Random(21)
    requests, resets = [], []
    for key in range(25):
        at, gap = rng.randint(1, 5000), rng.choice([5, 60, 400, 3000])
        for _ in range(rng.randint(1, 150)):
            at += rng.randint(0, gap)
            requests.append((len(requests), None if key == 3 else key, at, rng.randint(SKEW + 1, 4000), rng.random() < 0.6))
        resets += [(None if key == 3 else key, rng.randint(0, at)) for _ in range(rng.choice([0, 2, 9]))]
    df = spark.createDataFrame(requests, "request_id long, p int, at_us long, life long, good boolean")
    ends = spark.createDataFrame(resets, "p int, at_us long")
    for invalidated in (resets, []):
        got = renewals(df, ends if invalidated else None, ["p"], F.col("life"), 4000, F.col("good"), skew_us=SKEW)
        want = walked(requests, invalidated)
        assert {r.request_id: r.outcome for r in got.collect()} == want
        assert len(set(want.values())) == 4
    assert got.columns == [*df.columns, "outcome"]


def test_credentials_of_one_microsecond(spark):
    """The greatest order counts; requests keep their rows, repeated ones included."""
    requests = [(1, "p", 10, "wide"), (1, "p", 10, "wide"), (2, "p", 9, "w"), (3, "q", 50, "w"), (4, None, 7, "w"), (5, "p", 30, "w"), (6, "p", None, "w")]
    issued = [("p", 10, 1, "a"), ("p", 10, 3, "c"), ("p", 10, 2, "z"), ("p", 20, 9, "d"), (None, 7, 4, "n")]
    df = spark.createDataFrame(requests, "request_id long, p string, at_us long, body string")
    creds = spark.createDataFrame(issued, "p string, issued_at long, credential_id long, token string")
    got = credentials_in_force(df, creds, ["p"], order="credential_id", block_us=8)
    assert sorted((r.request_id, r.credential.token if r.credential else None) for r in got.collect()) == [
        (1, "c"), (1, "c"), (2, None), (3, None), (4, "n"), (5, "d"), (6, None),
    ]
    plain = {r.request_id: r.credential.token for r in credentials_in_force(df, creds, ["p"]).where("credential is not null").collect()}
    assert plain[1] == "c" and got.columns == [*df.columns, "credential"]


def test_windows_do_not_hold_whole_requests(spark):
    df = spark.createDataFrame([(1, "p", 10, "wide")], "request_id long, p string, at_us long, body string")
    creds = spark.createDataFrame([("p", 10, "t")], "p string, issued_at long, token string")
    plan = credentials_in_force(df, creds, ["p"])._jdf.queryExecution().optimizedPlan()
    for node in plan.toString().split("\n"):
        assert "Window" not in node or "body" not in node
    stack, windows = [plan], 0
    while stack:
        node = stack.pop()
        if node.nodeName() == "Window":
            windows += 1
            names = [node.output().apply(k).name() for k in range(node.output().size())]
            assert "body" not in names
        stack += [node.children().apply(k) for k in range(node.children().size())]
    assert windows
