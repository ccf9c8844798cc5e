"""Accuracy on held-out labels, gradients against differences, odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from emberwatch.llm import quality_classifier as qc


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in qc.query(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for k, r in got.items())
    held = [(got[k].predicted, q) for k, q in labels.items() if k in got and got[k].held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    bad = [p for p, q in held if q == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_learns_from_one_bad_passage():
    rng = np.random.default_rng(0)
    row = np.repeat(np.arange(300), 5)
    x = rng.normal(0, 1, (1500, qc.MEASURES + qc.WORD_BUCKETS))
    labels = np.ones(300)
    labels[::3] = 0
    x[np.arange(0, 300, 3) * 5 + rng.integers(0, 5, 100), 0] += 8  # one passage of each bad document tells
    model = qc.fit(row, x, labels)
    f = qc._forward(model, x, *qc._bags(row))
    assert ((f["s"] > 0.5) == labels).mean() > 0.97


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 0.5), (1, "", 0.1), (1, " \n", 0.1), (2, "ab " * 5000, 0.2), (2, "ab " * 5000, 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 0), (7, 1)], "doc_id long, quality int")
    model = qc.train(df, labels)
    got = qc.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1 and len({r.score for r in got if r.doc_id != 2}) == 1
    assert qc.score(df.limit(0), qc.train(df.limit(0), labels.limit(0))).count() == 0


def test_passages_cover_whole_texts():
    row, x = qc.passages(pa.array(["a " * 200, None, "b " * 64]))
    assert row.tolist() == [0, 0, 0, 0, 1, 2] and x.shape == (6, qc.MEASURES + qc.WORD_BUCKETS)
