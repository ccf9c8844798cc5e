"""Thinning, sliding counts, episodes and the taint fixpoint against brute force on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

import emberwatch.operators.bursts as bursts
from emberwatch.operators.carry import carry_last
from emberwatch.operators.taint_graph import earliest_taint, firing_uses
from emberwatch.operators.thinning import thin


def walked(events, hold, resets=()):
    """Ids kept by looking at one event after the other."""
    kept, free = [], -(2**62)
    for at, is_reset, event in sorted([(t, 0, i) for i, t in events] + [(r, 1, -1) for r in resets]):
        if is_reset:
            free = min(free, at + 1)
        elif at >= free:
            kept.append(event)
            free = at + hold
    return kept


@pytest.fixture(scope="module")
def timelines():
    rng, rows, resets = random.Random(5), [], []
    for key in range(40):
        gap, at = rng.choice([1, 3, 10, 60, 300]), rng.randint(0, 10**5)
        for _ in range(rng.randint(1, 300)):
            at += rng.randint(0, gap)
            rows.append((key, len(rows), at))
        resets += [(key, rng.randint(0, at + 10)) for _ in range(rng.choice([0, 0, 1, 5]))]
    return rows, resets


@pytest.mark.parametrize("hold, block_holds", [(10, 2), (10, 64), (60, 1)])
@pytest.mark.parametrize("with_resets", [False, True])
def test_thin_equals_walk(spark, timelines, hold, block_holds, with_resets):
    rows, resets = timelines
    events = spark.createDataFrame(rows, "key int, id bigint, at bigint")
    ends = spark.createDataFrame(resets, "key int, at bigint") if with_resets else None
    got = thin(events, ["key"], "at", "id", hold, resets=ends, block_holds=block_holds)
    want = [
        i for key in {k for k, _, _ in rows}
        for i in walked([(i, t) for k, i, t in rows if k == key], hold, [r for k, r in resets if with_resets and k == key])
    ]
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_holds_of_their_own(spark, timelines):
    """Each event that is kept holds as long as it says."""
    rows = [(k, i, t - 500, [5, 40, 0, None, 90][i % 5]) for k, i, t in timelines[0]]
    events = spark.createDataFrame(rows, "key int, id bigint, at bigint, hold bigint")
    got = thin(events, ["key"], "at", "id", F.col("hold"), longest_us=90, block_holds=2)
    want, free = [], {}
    for k, i, t, hold in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if t >= free.get(k, -(10**9)):
            want.append(i)
            free[k] = t + max(1, hold or 1)
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_one_key_with_many_dense_points(spark):
    """Ten million points of one key, a thousand in a hold, over many tasks."""
    n, hold = 10_000_000, 1000
    events = spark.range(n, numPartitions=8).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.col("id"))
    kept = thin(events, ["key"], "at", "id", hold)
    tasks = kept.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("at") % hold).alias("off")).collect()
    assert sum(r.n for r in tasks) == n // hold and sum(r.off for r in tasks) == 0
    assert len(tasks) >= 6


def test_thin_boundaries_and_payload(spark):
    times = [(1, "a", 0), (2, "a", 59), (3, "a", 60), (4, "a", 61), (5, "a", 119), (6, "a", 120), (7, "b", 59)]
    events = spark.createDataFrame(times, "id bigint, key string, at bigint").withColumn("note", F.lit("x"))
    kept = thin(events, ["key"], "at", "id", 60)
    assert kept.columns == ["key", "at", "id", "note"] or set(kept.columns) == set(events.columns)
    assert sorted(r.id for r in kept.collect()) == [1, 3, 6, 7]


@pytest.mark.parametrize("bucket", [4, 10, 33])
def test_sliding_count_and_episodes(spark, monkeypatch, bucket):
    monkeypatch.setattr(bursts, "TIE_SLICE", 7)
    rng = random.Random(7)
    events = [(i, rng.randint(0, 1500)) for i in range(1500)]
    counted = bursts.sliding_count(spark.createDataFrame(events, "id bigint, at bigint"), "at", "id", 10, bucket_us=bucket)
    ordered = sorted((t, i) for i, t in events)
    want = {i: sum(1 for u, j in ordered if t - 10 <= u and (u, j) <= (t, i)) for t, i in ordered}
    assert {r.id: r.window_count for r in counted.collect()} == want

    flagged = counted.filter("window_count >= 14").withColumn("reason", F.concat(F.lit("r"), "id"))
    episodes = []
    for t, i in ordered:
        if want[i] >= 14:
            if not episodes or t - episodes[-1][-1] > 20:
                episodes.append([t, i, f"r{i}", want[i], 0, t])
            episodes[-1][4:] = [episodes[-1][4] + 1, t]
    got = bursts.episodes(flagged, "at", "id", 20, block_us=100).orderBy("started_at")
    columns = ["started_at", "event_id", "reason", "burst_count", "n_events", "ended_at"]
    assert [list(r) for r in got.select(columns).collect()] == episodes


def test_carry_last(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, rng.randint(0, 500), rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, key int, at bigint, v bigint")
    got = {r.id: r.before for r in carry_last(df, ["key"], "at", "id", F.col("v"), "before", 25).collect()}
    last, want = {}, {}
    for i, key, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = last.get(key)
        last[key] = v if v is not None else last.get(key)
    assert got == want


def test_taint_fixpoint(spark):
    rng = random.Random(11)
    edges, want = [], set()
    for snippet in range(60):
        known = {}
        for seq in range(40):
            target, src = f"v{rng.randint(0, 9)}", rng.choice([None, *(f"v{k}" for k in range(10))])
            src = src if rng.random() < 0.9 else None
            edges.append((snippet, seq, target, src))
            if (src is None or known.get(src, seq) < seq) and target not in known:
                known[target] = seq
        want |= {(snippet, name, seq) for name, seq in known.items()}
    taints = earliest_taint(spark.createDataFrame(edges, "snippet_id bigint, seq bigint, target string, src string"))
    assert {(r.snippet_id, r.name, r.seq) for r in taints.collect()} == want


def test_firing_uses_take_the_first_candidate(spark):
    known = spark.createDataFrame([(1, "a", 3), (1, "b", -1)], "snippet_id bigint, name string, seq bigint")
    uses = [(1, 3, 0, 1, "a", "a"), (1, 3, 0, 2, "b", "b"), (1, 4, 0, 1, "a", "a"), (1, 4, 0, 2, "b", "b"),
            (1, 5, 0, 1, "z", "z"), (1, 6, 0, 9, None, "tainted_expression")]
    table = spark.createDataFrame(uses, "snippet_id bigint, seq bigint, sub int, cand_pos int, cand string, label string")
    assert {(r.seq, r.label) for r in firing_uses(table, known).collect()} == {(3, "b"), (4, "a"), (6, "tainted_expression")}
