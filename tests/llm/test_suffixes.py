"""Removed bytes against brute force, the column-wise construction against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest

from emberwatch.llm import repeats, shared, suffixes


def brute(rows, width):
    first = {}
    for k, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            first.setdefault(raw[i : i + width], (k, i))
    out = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if k is not None:
            for i in range(len(raw) - width + 1):
                if first[raw[i : i + width]] < (k, i):
                    gone[i : i + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((k, len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def test_rounds_give_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(50):
        m, n = rng.integers(1, 9), rng.integers(1, 12)
        table = rng.integers(97, 99, (m, n)).astype(np.uint8)
        ends = rng.integers(1, n + 1, m)
        for column, order, common in suffixes.suffix_rounds(table, ends):
            tails = [bytes(table[r, column : ends[r]]) for r in order]
            assert tails == sorted(bytes(table[r, column : ends[r]]) for r in range(m) if ends[r] > column)
            for i in range(1, len(tails)):
                shared_part = 0
                while tails[i - 1][shared_part : shared_part + 1] == tails[i][shared_part : shared_part + 1] != b"":
                    shared_part += 1
                assert common[i] == shared_part


@pytest.mark.parametrize("hot_rows", [20_000, 0])
def test_random_texts(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(suffixes, "COMMON_SAMPLE", 1)
    monkeypatch.setattr(suffixes, "COMMON_ROWS", hot_rows // 4000)
    monkeypatch.setattr(shared, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    pool = [some(260) for _ in range(5)]
    rows = [(None, pool[0]), (1000, None), (1001, ""), (1002, pool[1] * 3), (1003, "a" * 700), (1004, "ab" * 300)]
    for k in rng.sample(range(900), 60):
        cut = rng.choice(pool)
        rows.append((k, some(rng.randint(0, 90)) + cut[rng.randint(0, 150) :] + some(rng.randint(0, 40)) + rng.choice(pool) + some(5)))
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, kept string, h int")
    got = suffixes.remove_repeats(df, width=100).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got), key=repr) == brute(rows, 100)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_repeated_rows_are_alike(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(400))
    df = spark.createDataFrame([(5, text), (5, text), (2, "x" + text[:150])], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in suffixes.remove_repeats(df).collect()]
    assert len(got) == 3 and len({g for g in got if g[0] == 5}) == 1


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(k, n, m, s, hashlib.sha256(b).hexdigest()) for k, n, m, s, b in brute(rows, 100)]
    assert sorted((tuple(r) for r in suffixes.query(spark, folder).collect()), key=repr) == sorted(want, key=repr)
