"""Earliest taint over tables: the edges are shuffled once."""

import random

from emberwatch.operators import taint_graph as tg


def plain(edges):
    known, more = {}, True
    while more:
        more = False
        for snippet, seq, target, src in edges:
            since = -(10**9) if src is None else known.get((snippet, src))
            if since is not None and since < seq and seq < known.get((snippet, target), 10**9):
                known[snippet, target] = seq
                more = True
    return {(s, n, q) for (s, n), q in known.items()}


def test_long_chain_and_random_edges(spark):
    rng = random.Random(3)
    edges = [(1, 0, "n0", None)] + [(1, 10 * k + 10, f"n{k + 1}", f"n{k}") for k in range(25)]
    edges += [(rng.randrange(2, 6), q, f"v{rng.randrange(12)}", None if rng.random() < 0.05 else f"v{rng.randrange(12)}") for q in rng.sample(range(1000), 300)]
    got = tg.earliest_taint(spark.createDataFrame(edges, "snippet_id bigint, seq bigint, target string, src string"))
    assert {(r.snippet_id, r.name, r.seq) for r in got.collect()} == plain(edges)


def test_rounds_find_edges_where_they_are(spark, monkeypatch):
    plans = []
    round_ = tg._round
    monkeypatch.setattr(tg, "_round", lambda taints, path: plans.append(taints._jdf.queryExecution().executedPlan().toString()) or round_(taints, path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = [(1, 0, "a", None), (1, 5, "b", "a"), (1, 9, "c", "b")]
        got = tg.earliest_taint(spark.createDataFrame(edges, "snippet_id bigint, seq bigint, target string, src string"))
        assert got.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 3
    for plan in plans:
        # Only the names that are new are dealt out to the edges' buckets.
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("taint_steps")]
