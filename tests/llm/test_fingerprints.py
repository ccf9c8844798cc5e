"""Sketches against exact sets, the next document against a sort."""

import hashlib
import re

from pyspark.sql import functions as F

from emberwatch.llm import fingerprints as fp


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), reverse=True)
    want = {}
    for (k, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        part = len(text) // 3
        want[k] = (text, text[: len(text) - part] + following[:part], following)
    for rows in (2000, 7):
        monkeypatch.setattr(fp, "RANGE_ROWS", rows)
        got = fp.query(spark, folder).collect()
        assert len(got) == len(docs)
        worst = 0
        for r in got:
            text, edited, following = want[r.doc_id]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            for other, near in ((edited, r.near_edited), (following, r.near_next)):
                worst = max(worst, abs(near - likeness(shingles(text), shingles(other))))
        assert worst < 0.15


def test_estimates_and_merging(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    part = " ".join(f"w{i}" for i in range(1500))
    df = spark.createDataFrame([(1, text, part), (2, "", None), (None, "a b", "a b")], "k int, a string, b string")
    df = df.select("k", fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    big, empty, small = df.select(fp.resemblance(a, b), fp.containment(b, a), fp.containment(a, b), fp.distinct_shingles(a)).collect()
    assert abs(big[0] - 0.5) < 0.12 and big[1] > 0.85 and abs(big[2] - 0.5) < 0.15 and abs(big[3] / 2996 - 1) < 0.2
    assert tuple(empty) == (1.0, 1.0, 1.0, 0.0) and tuple(small) == (1.0, 1.0, 1.0, 1.0)
    twice = df.select("k", "a").unionByName(df.select("k", F.col("b").alias("a")))
    got = {r.k: r.a for r in fp.merged(twice, ["k"], "a").collect()}
    assert got == {r.k: r.m for r in df.select("k", fp.merge(a, b).alias("m")).collect()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, "x y", 1), (None, "null id", 1), (5, "x y", 1), (7, None, 1), (5, "other", 1)], "i long, t string, next_t int")
    got = sorted(((r.i, r.t, r.next_t) for r in fp.with_next(df, "i", "t").collect()), key=repr)
    assert len(got) == 5 and ("7", "") not in got
    assert [g for g in got if g[0] is None] == [(None, "null id", "")]
    assert [g[2] for g in got if g[0] == 7][0] in ("x y", "other")
    assert fp.with_next(df.limit(0), "i", "t").count() == 0
    one = fp.with_next(df.where("i = 7"), "i", "t").collect()
    assert [(r.t, r.next_t) for r in one] == [("", "")]
