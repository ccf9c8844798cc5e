"""Packing against sequential best fit, cuts against the library, odd rows."""

import bisect
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from emberwatch.llm import packing
from emberwatch.llm.shared import tokenizer_file


def best_fit(sizes, capacity):
    gaps, bins = [], 0
    for x in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bins += at == len(gaps) and gap == capacity
        bisect.insort(gaps, gap - x)
    return bins


def test_about_as_few_as_best_fit(spark):
    rng = random.Random(8)
    for draw in (lambda: rng.randint(1, 1024), lambda: rng.randint(1, 40), lambda: rng.choice([300, 341, 342, 512, 700, 1024])):
        sizes = [draw() for _ in range(1500)]
        df = spark.createDataFrame([*enumerate(sizes)], "item long, size long")
        got = packing.pack(df, sweep_rows=200).collect()
        assert sorted(r.item for r in got) == list(range(len(sizes)))
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, sizes[r.item]))
        for members in bins.values():
            place = 0
            for offset, size in sorted(members):
                assert offset == place
                place += size
            assert place <= 1024
        assert len(bins) <= 1.03 * max(best_fit(sizes, 1024), -(-sum(sizes) // 1024)) + 1
        if draw() >= 300:
            break


def test_cuts_and_odd_rows(spark):
    whole = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = [None, "", "word " * 3000, "a <|endoftext|> b\n\n  c  ", "é漢😀 " * 400, "x" * 5000, "word " * 3000]
    rows = [(k if k else None, t, "p", 9) for k, t in enumerate(texts)] + [(3, "again", "p", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, uid int")
    got = packing.pack_documents(df, with_ids=True).collect()
    by_doc = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(texts):
        if k and k != 3:
            pieces = sorted(by_doc[k], key=lambda r: r.piece)
            ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in pieces]).tolist()
            assert ids == [*whole.encode(t or "", add_special_tokens=False).ids, 2]
            assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces[:-1]]).tolist()
            assert all(r.length == 1024 for r in pieces[1:]) and [r.piece for r in pieces] == list(range(len(pieces)))
    assert [r.length for r in by_doc[None]] == [1] and len(by_doc[3]) == 2
    assert packing.pack_documents(df.limit(0)).count() == 0
