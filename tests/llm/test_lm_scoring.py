"""Scores against plain Python with dictionaries of contexts, and against the word base on documents that do not teach."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberwatch.llm import lm_scoring as lm


def said(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain(docs, order):
    """docs: (id, text, teaches). Scores by walking each byte's contexts from the longest."""
    seen, tokens = defaultdict(Counter), Counter()
    for _, text, teaches in docs:
        if teaches:
            data = b"\n" * order + " ".join(said(text)).encode() + b"\n"
            tokens.update([*said(text), None])
            for i in range(order, len(data)):
                seen[data[i - order : i]][data[i]] += 1
    for k in range(order, 0, -1):
        for context in [c for c in seen if len(c) == k]:
            for byte in seen[context]:
                seen[context[1:]][byte] += 1
    out = []
    for doc, text, teaches in docs:
        words = [*said(text), None]
        n = sum(tokens.values())
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (len(tokens) + 1))) for w in words)
        data, total = b"\n" * order + " ".join(said(text)).encode() + b"\n", 0.0
        for i in range(order, len(data)):
            left_out = set()
            for k in range(order, -1, -1):
                had = {b: m for b, m in seen.get(data[i - k : i], {}).items() if b not in left_out}
                if not had:
                    continue
                sums = 2 * sum(had.values())
                if data[i] in had:
                    total += math.log10((2 * had[data[i]] - 1) / sums)
                    break
                total += math.log10(len(had) / sums)
                left_out |= set(had)
            else:
                total -= math.log10(256 - len(left_out))
        out.append((doc, teaches, len(words), sum(tokens[w] > 0 for w in words), n, base, total))
    return out


def same(got, want):
    got, want = (sorted(x, key=repr) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 4, 5])
def test_equals_plain_python(spark, order):
    rng = random.Random(order)
    words = ["ab", "Abra", "cad", "é漢", "x" * 30, "\x1c", "😀", "brab"]
    docs = [(k, " ".join(rng.choice(words) + rng.choice(["", "a", "b"]) for _ in range(rng.randint(0, 60))), rng.random() < 0.7) for k in range(60)]
    docs += [(60, None, True), (61, "", False), (62, " \n\t", True), (None, "zq zq NEW", False), (5, "again", True), (5, "again", True)]
    df = spark.createDataFrame([(*d, 3, "x") for d in docs], "doc_id long, text string, t boolean, block int, said string")
    same([tuple(r) for r in lm.score(df, F.col("t"), order=order).collect()], plain(docs, order))


def test_small_blocks_and_steps(spark, monkeypatch):
    """Texts longer than a block or a step, and blocks that several tasks read."""
    for name, value in (("BLOCK_BYTES", 200), ("STEP_BYTES", 64), ("STEP_TEXTS", 3)):
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(rng.randint(0, 80))), k % 3 > 0) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, t boolean")
    same([tuple(r) for r in lm.score(df, F.col("t")).collect()], plain(docs, lm.ORDER))


def test_nothing_teaches(spark):
    docs = [(1, "one two", None), (2, None, False)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string, t boolean"), F.col("t")).collect()}
    assert got[1].score == pytest.approx(-8 * math.log10(256)) and got[1].train_tokens == got[1].n_known == 0
    assert lm.score(spark.createDataFrame([], "doc_id long, text string, t boolean"), F.col("t")).count() == 0


def test_probabilities_sum_to_one(spark):
    """Over all next bytes after a context, escapes included."""
    counts = Counter({b"\n\n": 3, b"\na": 2, b"aa": 1, b"ab": 4, b"ba": 2, b"bb": 1, b"bc": 1, b"ca": 1})
    every = [(int.from_bytes(bytes([x, y]), "big"), counts[bytes([x, y])]) for x in b"\nabcz" for y in range(256)]
    got = defaultdict(float)
    for r in lm.costs(lm.levels(spark.createDataFrame(every, "gram long, n long"), 1)).collect():
        got[r.gram >> 8] += 10**-r.cost
    assert len(got) == 5 and all(v == pytest.approx(1) for v in got.values())


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r) for r in lm.query(spark, folder).collect()]
    assert len(got) == len(docs)
    few = {d[0] for d in docs if len(d[1] or "") < 1500}
    counts = Counter(t for _, text, teaches in docs if teaches for t in [*said(text), None])
    n, v = sum(counts.values()), len(counts)
    for doc, text, teaches in docs:
        if doc in few:
            row = next(r for r in got if r[0] == doc)
            words = [*said(text), None]
            assert row[1:5] == (not teaches, len(words), sum(counts[w] > 0 for w in words), n)
            assert row[5] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))


def test_predicts_documents_that_do_not_teach(spark):
    """Better than the words of the base, to which a new word costs the same however long it is."""
    held = [r for r in lm.query(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert len(held) > 1500 and sum(r.score for r in held) > sum(r.base_score for r in held)
