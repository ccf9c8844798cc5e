"""Removed words against brute force over all windows."""

import hashlib
import random
import re

import pytest

from emberwatch.llm import repeats, shared, substrings


def brute(rows, width):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (k, _), ws in zip(rows, words, strict=True):
        if k is not None:
            for i in range(len(ws) - width + 1):
                w = tuple(ws[i : i + width])
                first[w] = min(first.get(w, k), k)
    out = []
    for (k, _), ws in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(ws) - width + 1):
            if k is not None and first[tuple(ws[i : i + width])] < k:
                gone.update(range(i, i + width))
        out.append((k, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [20_000, 0])
def test_random_texts(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(shared, "BLOCK_BYTES", 700)
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(40)) for _ in range(6)]
    rows = [(None, pool[0]), (7, None), (8, ""), (8, pool[1]), (8, pool[1] + " " + pool[2]), (3, pool[1]), (3, pool[1])]
    for k in range(60):
        parts = [" ".join(rng.choice(["x", "yy", "zzz", "é", "w1", "w2", "w3"]) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        cut = rng.choice(pool).split()
        a = rng.randint(0, 30)
        rows.append((rng.randint(0, 50), f"{parts[0]} {' '.join(cut[a:])}\n{parts[1]} {rng.choice(pool)} \t{parts[2]}"))
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, spans string, d int")
    got = substrings.remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute(rows, 13)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute(rows, 13)]
    assert sorted((tuple(r) for r in substrings.query(spark, folder).collect()), key=repr) == sorted(want, key=repr)


def thue_morse(n):
    """Words that polynomial hashes modulo a power of two take for equal, whatever their base."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_weak_hashes_confuse(spark):
    t, u = thue_morse(2048)
    head = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{head} {t}"), (2, f"{head} {u}"), (3, f"{head} {t}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_span_hashes_against_slices():
    """Equal exactly where the bytes are, wherever they stand."""
    import numpy as np

    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 3000)
    ends = starts + rng.integers(0, 12, 3000)
    pieces = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    late = starts >= 100
    for of in (shared.field_hashes, lambda d, s, e: shared.span_hashes(shared.prefix_hashes(d), s, e)):
        hashes = of(data, starts, ends)
        assert len(set(hashes.tolist())) == len(set(pieces)) == len(set(zip(pieces, hashes.tolist(), strict=True)))
        assert (of(data[100:], starts[late] - 100, ends[late] - 100) == hashes[late]).all()
