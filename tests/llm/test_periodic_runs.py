"""Runs against brute force over all periods; transforms against sums."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from emberwatch.llm import periodic_runs as pr


def brute(words):
    """(start, length, period) of all runs, by walking every period and keeping stretches without a smaller one."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q):
                piece = words[i : i + length]
                if not any(piece[p:] == piece[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return " ".join(w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs))


def samples(rng, n):
    for _ in range(n):
        words = [rng.choice("ab") if rng.random() < 0.7 else rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abcdefghij") for _ in range(rng.randint(1, rng.choice([3, 10, 60])))]
            if rng.random() < 0.3:
                unit = unit * 2 + [rng.choice("abc")]
            words += (unit * rng.randint(1, 7))[: rng.randint(1, 300)] + [rng.choice("ab") for _ in range(rng.randint(0, 5))]
        yield words


@pytest.mark.parametrize("n", [2, 16, 32, 64, 1024, 4096])
def test_transform_round_trip_and_convolution(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(-pr.PRIME // 2, pr.PRIME // 2, (n, 3)).astype(float) for _ in range(2))
    assert np.array_equal(pr.inverse(pr.transform(a)) % pr.PRIME, a % pr.PRIME)
    got = pr.inverse(pr._centred(pr.transform(a) * pr.transform(b)))
    for k in range(0, n, max(1, n // 8)):
        want = sum(int(a[j, 1]) * int(b[(k - j) % n, 1]) for j in range(n))
        assert int(got[k, 1]) % pr.PRIME == want % pr.PRIME


@pytest.mark.parametrize("longest", [pr.LONGEST_TRANSFORM, 64])
def test_runs_equal_brute_force(longest):
    rng = random.Random(3)
    texts = sorted(samples(rng, 400), key=len, reverse=True)
    codes = np.array([ord(w) for t in texts for w in t])
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = pr.runs_of(codes, bounds, longest)
    want = [(b + s, b + s + n, q) for t, b in zip(texts, bounds, strict=False) for s, n, q in brute(t)]
    assert len(want) > 150
    assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_one_word_a_hundred_thousand_times():
    texts = [np.full(100_000, 7), np.tile(np.arange(1000), 60)]
    bounds = np.array([0, 100_000, 160_000])
    assert pr.runs_of(np.concatenate(texts), bounds).tolist() == [[0, 100_000, 1], [100_000, 160_000, 1000]]


def test_odd_rows(spark):
    line = "one two three four " * 9
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "w " * 30), (5, line), (5, line), (6, "\x1c\x85 " * 24), (7, "é漢 😀 " * 20), (8, "w " * 23)]
    df = spark.createDataFrame([(k, t, 9, "x") for k, t in rows], "doc_id long, text string, runs int, id string")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in pr.collapse_runs(df).collect())
    want = []
    for k, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want.append((k or 0, len(words), brute(words), kept(words, brute(words))))
    assert got == sorted(want)
    assert pr.collapse_runs(df.limit(0)).count() == 0


def expected(doc_id, text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept(words, runs)))


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:8] for r in pr.query(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in docs if len((r.text or "").split()) < 4000} | {
        r.doc_id: got[r.doc_id] for r in docs if len((r.text or "").split()) >= 4000
    }
    assert sum(v[0] > 0 for v in got.values()) > 5
