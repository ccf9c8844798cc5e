"""The trie against plain Python and its SQL; contraction on chains, stars and random trees."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from emberwatch.llm import prefix_trie as pt
from emberwatch.llm.tree_contraction import subtree_totals


def plain_trie(rows):
    """Contract of the query over (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, cs in members.items():
        below, stack = [], [p]
        while stack:
            below.append(stack.pop())
            stack += kids[below[-1]]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if whole[c] == p)))
        parent = min(members[p[:-1]]) if p else None
        leaves = sum(not kids[q] for q in below)
        out.append((min(cs), len(p), parent, len(cs), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(df):
    return sorted(map(tuple, pt.trie(*pt.with_shared_heads(pt.numbered_turns(df))).collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, pos string, _range int"


def test_random_conversations(spark):
    rng = random.Random(8)
    rows = []
    for c in rng.sample(range(200), 90):
        hot = rng.random() < 0.4
        for t in range(rng.randint(1, 9)):
            turn = None if rng.random() < 0.05 and t == 0 else t
            text = "hello" if hot else rng.choice(["a", "é漢", "", None, "hello"])
            rows.append((c, turn, rng.choice(["user", None, ""]) if not hot else "user", text, "x", 3))
    rows += [(None, 0, "user", "lost", "x", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert built(df) == plain_trie([r[:4] for r in rows])
    assert built(df.limit(0)) == []


def test_one_long_conversation(spark):
    """A chain of many turns, of which one is repeated row by row."""
    rows = [(5, t, "user", f"t{t % 3}", "x", 3) for t in range(60)] + [(7, None, "user", "same", "x", 3)] * 3 + [(6, 0, None, None, "x", 3)]
    assert built(spark.createDataFrame(rows, SCHEMA)) == plain_trie([r[:4] for r in rows])


def trees():
    rng = random.Random(4)
    yield "chain", [None, *range(120)]
    yield "star", [None] + [0] * 200
    yield "random", [None, None] + [rng.randrange(k) for k in range(2, 200)]
    yield "brush", [None, *range(40)] + [rng.randrange(41) for _ in range(100)]


@pytest.mark.parametrize(("name", "parents"), list(trees()))
def test_subtree_totals(spark, name, parents):
    want = [[k % 7, 1] for k in range(len(parents))]
    for k in range(len(parents) - 1, -1, -1):
        p = parents[k]
        if p is not None:
            want[p] = [a + b for a, b in zip(want[p], want[k], strict=True)]
    rows = [(k, p, None if k % 7 == 0 else k % 7, 1, "x") for k, p in enumerate(parents)]
    df = spark.createDataFrame(rows, "id long, parent long, a long, b long, inner string")
    got = {r.id: [r.a, r.b] for r in subtree_totals(df, ["a", "b"]).collect()}
    assert got == dict(enumerate(want))


def test_no_tree(spark):
    assert subtree_totals(spark.createDataFrame([(None, 1, 2)], "id long, parent long, a long"), ["a"]).count() == 0


def test_running_sums_over_many_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.expr("if(id % 5 = 0, null, id div 4)").alias("t"), F.lit(1).cast("long").alias("n"))
    got = [(r.k, -1 if r.t is None else r.t, r.n) for r in pt.running_sums(df, "k", ["t"], ["n"]).collect()]
    for k in (0, 1):
        mine = sorted((t, n) for q, t, n in got if q == k)
        assert [n for _, n in mine] == list(range(1, 1501))


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(pt.query(spark, folder), connect(folder), pt.SQL) is None
