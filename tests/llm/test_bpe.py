"""Tree concatenation against the library's own encoding of whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from emberwatch.llm import bpe
from emberwatch.llm.byte_pairs import word_vocabulary
from emberwatch.llm.shared import tokenizer_file


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    letters = "etaoinshrdluéèßñ"
    long_run = "".join(rng.choice(letters) for _ in range(9000))
    return [
        None, "", "   ", "Hello, World! It's 12 o'clock...", "a b c\x1fd", "<|endoftext|>", "x<|startoftext|>y <|endoftext|",
        "ΑΣ ΟΔΟΣ été Å İstanbul ﬁ ²³ ١٢ 漢字かな交じり文", long_run, long_run + "!!" + "1" * 300 + " tail 'S",
        "漢字" * 2000, "a" * 5000, "'" * 4000 + "s", "the " * 2000, "😀👍🏽" * 300, "́" * 1500,
    ]


def test_equals_library(spark, whole):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(3, "repeated id", "x", 1), (None, "no id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, row int")
    got = sorted(((r.doc_id, r.decoded), list(r.ids)) for r in bpe.encode(df, leaf_bytes=256).collect() if r.doc_id is not None)
    want = []
    for i, t, *_ in rows:
        if i is not None:
            ids = whole.encode(t or "", add_special_tokens=False).ids
            want.append(((i, whole.decode(ids, skip_special_tokens=False)), ids))
    assert got == sorted(want)
    assert bpe.encode(df).count() == len(rows)


def test_windows_grow_until_sides_agree():
    v = word_vocabulary()
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("aeinst") for _ in range(rng.randint(2, 60))).encode() + v.END
        cut = rng.randint(0, len(piece))
        import numpy as np

        left, right = (np.array(v.merge(x), np.int64) if x else np.zeros(0, np.int64) for x in (piece[:cut], piece[cut:]))
        assert bpe.join_halves(v, piece, left, right, window=1).tolist() == v.merge(piece)


def test_tokens_are_reachable(whole):
    """Each token's own bytes merge to it, which the joins rest on."""
    v = word_vocabulary()
    from emberwatch.llm.bpe import _bytes

    never = {0xC0, 0xC1, *range(0xF5, 0x100)}  # bytes that UTF-8 does not have
    for name in sorted(whole.get_vocab())[::7]:
        if name not in v.specials and not never & set(_bytes(name.removesuffix("</w>"))):
            piece = _bytes(name.removesuffix("</w>")) + (v.END if name.endswith("</w>") else b"")
            assert [v.names[r] for r in v.merge(piece)] == [name]
            if len(piece) > 1:  # also when the whole is not looked up
                half = len(piece) // 2
                import numpy as np

                sides = [np.array(v.merge(x), np.int64) for x in (piece[:half], piece[half:])]
                assert [v.names[r] for r in bpe.join_halves(v, piece, *sides)] == [name]


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_documents(spark, whole):
    import hashlib

    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id] = (len(ids), digest(" ".join(map(str, ids))), digest(whole.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r)[1:] for r in bpe.query(spark, folder).collect()} == want
