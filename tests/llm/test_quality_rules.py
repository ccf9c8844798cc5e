"""Measures against plain Python, votes against the labels of the tables."""

import re
from collections import Counter

from emberwatch.llm import quality_rules as qr


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_measures_and_odd_rows(spark):
    texts = [None, "", " \n\t", "a b", "a a a a", "a b c a b c a b", "x\ny\nx\n\n \n x", "x\x0by\xa0z #|<\n", "é漢😀 é漢😀 é漢😀 é漢😀", "w " * 30_000]
    rows = [(k if k else None, t, 5, "v") for k, t in enumerate([*texts, texts[5]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = qr.score(df).collect()
    want = Counter((k, *measures(t)) for k, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert qr.score(df.limit(0)).count() == 0


def test_query_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in qr.query(spark, folder).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {k: tuple(r)[1:7] for k, r in got.items()} == {k: measures(t) for k, t in docs.items()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    right = [got[r.doc_id].kept == bool(r.quality) for r in labels if r.doc_id in got and not got[r.doc_id].base_failed]
    assert sum(right) >= 0.97 * len(right)
