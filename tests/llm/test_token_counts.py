"""Edited trees against encoding the edited text anew."""

import random

from emberwatch.llm import token_counts as tc
from emberwatch.llm.byte_pairs import byte_ids


def test_edits_count_like_a_new_encoding():
    rng = random.Random(3)
    alphabet = "ab  \n.'s12é漢\t"
    for _ in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
        lengths, counts, place = tc.leaf_lengths(text, 20), [], 0
        for n in lengths:
            counts.append(len(byte_ids(text[place : place + n])))
            place += n
        tree = tc.Tree.build(lengths, counts)
        for _ in range(6):
            start, removed = rng.randint(-3, len(text) + 3), rng.randint(0, 60)
            added = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 500])))
            tree, text, _ = tc.edit_tree(tree, text, start, removed, added, 20)
            assert tree.chars[1] == len(text)
            assert tree.tokens[1] == len(byte_ids(text))


def test_small_edits_encode_little():
    text = "The quick brown fox jumps over it. " * 3000
    lengths = tc.leaf_lengths(text, 1024)
    tree = tc.Tree.build(lengths, [len(byte_ids(text[sum(lengths[:k]) : sum(lengths[: k + 1])])) for k in range(len(lengths))])
    tree, edited, spent = tc.edit_tree(tree, text, 50_000, 3, "cat", 1024)
    assert tree.tokens[1] == len(byte_ids(edited)) and spent < 5000


def test_query_and_odd_rows(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = tc.query(spark, folder).collect()
    assert len(got) == len(texts)
    assert all(r.n_tokens == len(byte_ids(texts[r.doc_id] or "")) for r in got)
    rows = [(None, None, 1), (1, "", 2), (1, "a <|endoftext|> b", 3), (2, "x" * 20_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tree int")
    trees = tc.build_trees(df)
    assert sorted(r.tree.tokens[1] for r in trees.collect()) == sorted(len(byte_ids(t or "")) for _, t, _ in rows)
    edits = spark.createDataFrame([([(0, 1, "<|endoftext|>"), None, (5, -2, None)],), (None,)], f"edits array<{tc.EDIT}>")
    changed = tc.apply_edits(trees.crossJoin(edits))
    assert all(r.tree.tokens[1] == len(byte_ids(r.text)) for r in changed.collect())
    assert tc.build_trees(df.limit(0)).count() == 0
