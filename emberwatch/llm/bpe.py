"""BPE encoding and decoding with the 49k word vocabulary; long unsplit text by tree concatenation.

White space separates runs, and runs encode alone, so a text is the concatenation of its runs. Within a run the
vocabulary's rules give pieces; merges never leave a piece. A piece longer than a leaf has nothing that splits it: it is
cut into leaves that different tasks encode, and encodings are joined in a tree. At each join a window of tokens around the
cut is encoded again and doubled until its first token is a token of the left side and its last one of the right side.
Every pair of neighbours then stands in an encoding by the same merges, which makes the whole the encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.byte_pairs import WordVocabulary, word_vocabulary
from emberwatch.llm.shared import documents, process_cache

#: Bytes of a leaf: what one task encodes of a piece that nothing splits.
LEAF_BYTES = 4096
#: Tokens on each side of a join that are encoded again at first.
WINDOW_TOKENS = 8
#: Runs whose encoding a worker remembers at once.
REMEMBERED_RUNS = 300_000
#: Characters of text per batch that goes back to Spark.
BATCH_CHARS = 1 << 20

_ASCII_RUN = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def runs_of(text: str) -> list[str]:
    """Runs without ASCII white space."""
    return _ASCII_RUN.findall(text) if _OTHER_SPACE.search(text) else text.split()


def run_pieces(vocabulary: WordVocabulary, run: str) -> list[bytes | int]:
    """Pieces of a run as bytes with the mark of their end; special tokens as their id."""
    if vocabulary.plain(run):
        return vocabulary.pieces(run)
    out: list[bytes | int] = []
    whole = vocabulary.whole
    for part in re.split("(" + "|".join(map(re.escape, vocabulary.specials)) + ")", run):
        if part in vocabulary.specials:
            out.append(whole.token_to_id(part))
        elif part:
            shown = whole.pre_tokenizer.pre_tokenize_str(whole.normalizer.normalize_str(part))
            out += [_bytes(piece) + vocabulary.END for piece, _ in shown]
    return out


def _bytes(shown: str) -> bytes:
    from emberwatch.llm.byte_pairs import _shown_bytes

    cache = process_cache()
    if "shown" not in cache:
        cache["shown"] = _shown_bytes()
    return bytes(map(cache["shown"].__getitem__, shown))


def join_halves(vocabulary: WordVocabulary, piece: bytes, left: np.ndarray, right: np.ndarray, window: int = WINDOW_TOKENS) -> np.ndarray:
    """Encoding of ``piece`` from the encodings (ranks) of its two parts."""
    left_ends, right_ends = np.cumsum(vocabulary.lengths[left]), np.cumsum(vocabulary.lengths[right])
    cut = int(left_ends[-1]) if len(left) else 0
    while True:
        i, j = max(0, len(left) - window), min(len(right), window)
        start = int(left_ends[i - 1]) if i else 0
        stop = cut + (int(right_ends[j - 1]) if j else 0)
        again = vocabulary.merge(piece[start:stop]) if stop > start else []
        agrees_left = i == 0 or again[0] == left[i]
        agrees_right = j == len(right) or again[-1] == right[j - 1]
        if agrees_left and agrees_right:
            return np.concatenate([left[:i], np.array(again, np.int64), right[j:]])
        window *= 2


def join_tree(vocabulary: WordVocabulary, leaves: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
    """Encoding of the concatenated leaves; neighbours are joined level by level."""
    while len(leaves) > 1:
        leaves = [
            (a[0] + b[0], join_halves(vocabulary, a[0] + b[0], a[1], b[1])) for a, b in zip(leaves[0::2], leaves[1::2], strict=False)
        ] + leaves[len(leaves) // 2 * 2 :]
    return leaves[0][1]


def cut_leaves(piece: bytes, leaf_bytes: int) -> list[bytes]:
    """The piece in parts of at most leaf_bytes, all of about the same length."""
    count = -(-len(piece) // leaf_bytes)
    edges = [len(piece) * k // count for k in range(count + 1)]
    return [piece[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def encode_run(vocabulary: WordVocabulary, run: str, leaf_bytes: int = LEAF_BYTES) -> list[int]:
    ids: list[int] = []
    for piece in run_pieces(vocabulary, run):
        if isinstance(piece, int):
            ids.append(piece)
        elif len(piece) <= leaf_bytes:
            ids += vocabulary.ids[vocabulary.merge(piece)].tolist()
        else:
            leaves = [(leaf, np.array(vocabulary.merge(leaf), np.int64)) for leaf in cut_leaves(piece, leaf_bytes)]
            ids += vocabulary.ids[join_tree(vocabulary, leaves)].tolist()
    return ids


def _remembered(vocabulary: WordVocabulary, leaf_bytes: int):
    """run -> (ids as bytes, decoded text), remembering short runs."""
    known = process_cache().setdefault("runs", {})

    def encoded(run: str) -> tuple[bytes, str]:
        ids = encode_run(vocabulary, run, leaf_bytes)
        entry = (np.array(ids, np.int32).tobytes(), " ".join([vocabulary.token_of[i] for i in ids]))
        if len(run) <= 64:
            if len(known) >= REMEMBERED_RUNS:
                known.clear()
            known[run] = entry
        return entry

    return known, encoded


def _encode_batches(path: str | None, leaf_bytes: int, n_keys: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_vocabulary(path)
        known, encoded = _remembered(vocabulary, leaf_bytes)
        for batch in batches:
            start, size = 0, 0
            ids, decoded, lengths = [], [], []
            for row, text in enumerate(batch.column(n_keys)):
                text = text.as_py() or ""
                entries = [known.get(run) or encoded(run) for run in runs_of(text)]
                ids += [e[0] for e in entries]
                lengths.append(sum([len(e[0]) for e in entries]) // 4)
                decoded.append(" ".join([e[1] for e in entries if e[1]]))
                size += len(text)
                if size >= BATCH_CHARS or row == batch.num_rows - 1:
                    yield _encoded_batch(batch.slice(start, row + 1 - start), n_keys, ids, lengths, decoded)
                    start, size = row + 1, 0
                    ids, decoded, lengths = [], [], []

    return encode


def _encoded_batch(batch, n_keys, ids, lengths, decoded):
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.frombuffer(b"".join(ids), np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
    names = [f.name for f in batch.schema][:n_keys]
    return pa.RecordBatch.from_arrays([batch.column(k) for k in range(n_keys)] + [lists, pa.array(decoded, pa.string())], [*names, "ids", "decoded"])


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf_bytes: int = LEAF_BYTES
) -> DataFrame:
    """Ids and decoded text of every row.

    Returns (id_col, ids array<int>, decoded string), one row per input row. A null text is the empty text: no ids, empty
    decoded text. Ids may be null or repeat; each row is encoded on its own. Other columns, whatever their names,
    are not looked at. ``vocabulary`` is the path of the vocabulary file on the workers.

    Rows without a run of leaf_bytes characters stay where they are. Of the others each leaf is a row of its
    own, so one very long run is encoded by many tasks; only its ids meet again.
    """
    base = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A run's bytes are at most 4 per character, and a few more once in lower case.
    long_run = (F.length("text") > leaf_bytes // 4) & F.expr(f"text rlike '[^\\\\x20\\\\x09-\\\\x0D]{{{leaf_bytes // 4}}}'")
    key_type = docs.schema[id_col].dataType.simpleString()
    short = base.where(~long_run).mapInArrow(_encode_batches(vocabulary, leaf_bytes, 1), f"key {key_type}, ids array<int>, decoded string")
    return short.unionByName(_encode_long(base.where(long_run), vocabulary, leaf_bytes, key_type)).withColumnRenamed("key", id_col)


def _encode_long(base: DataFrame, path: str | None, leaf_bytes: int, key_type: str) -> DataFrame:
    """Rows with long runs: leaves as rows, encoded apart, joined per row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_vocabulary(path)
        known, encoded = _remembered(vocabulary, leaf_bytes)
        for batch in batches:
            for key, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple[int, bytes, bytes]] = []  # group of leaves, bytes to encode, ids
                for run in runs_of(text):
                    if len(run) < leaf_bytes // 4:
                        rows.append((-1, b"", (known.get(run) or encoded(run))[0]))
                        continue
                    for piece in run_pieces(vocabulary, run):
                        if isinstance(piece, int):
                            rows.append((-1, b"", np.array([piece], np.int32).tobytes()))
                        else:
                            group = len(rows)
                            rows += [(group, leaf, b"") for leaf in cut_leaves(piece, leaf_bytes)]
                merged: list[tuple[int, bytes, bytes]] = []
                for r in rows:  # what is encoded already travels in one row
                    if r[0] < 0 and merged and merged[-1][0] < 0 and len(merged[-1][2]) < 1 << 16:
                        merged[-1] = (-1, b"", merged[-1][2] + r[2])
                    else:
                        merged.append(r)
                merged = merged or [(-1, b"", b"")]
                n = len(merged)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, batch.schema[0].type), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int64()),
                     pa.array([m[0] for m in merged], pa.int64()), pa.array([m[1] for m in merged], pa.binary()), pa.array([m[2] for m in merged], pa.binary())],
                    ["key", "row", "seq", "part", "leaf", "ids"],
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_vocabulary(path)
        for batch in batches:
            ranks = [np.array(vocabulary.merge(x), np.int64).tobytes() if x else b"" for x in batch.column("leaf").to_pylist()]
            yield batch.append_column("ranks", pa.array(ranks, pa.binary()))

    def join(_, rows: pd.DataFrame) -> pd.DataFrame:
        vocabulary = word_vocabulary(path)
        rows = rows.sort_values("seq")
        out: list[np.ndarray] = []
        waiting: list[tuple[bytes, np.ndarray]] = []
        parts = [*zip(rows["part"], rows["leaf"], rows["ids"], rows["ranks"], strict=True), (-1, b"", b"", b"")]
        group = -1
        for part, leaf, ids, ranks in parts:
            if waiting and part != group:
                out.append(vocabulary.ids[join_tree(vocabulary, waiting)])
                waiting = []
            group = part
            if part >= 0:
                waiting.append((bytes(leaf), np.frombuffer(ranks, np.int64)))
            else:
                out.append(np.frombuffer(ids, np.int32))
        ids = np.concatenate(out).astype(np.int32)
        decoded = " ".join([vocabulary.token_of[i] for i in ids.tolist()])
        key = rows["key"].iloc[0]
        return pd.DataFrame({"key": [None if pd.isna(key) else key], "ids": [ids.tolist()], "decoded": [decoded]})

    numbered = base.withColumn("row", F.monotonically_increasing_id()).select("key", "row", "text")
    schema = f"key {key_type}, row long, seq long, part long, leaf binary, ids binary"
    cut_rows = numbered.mapInArrow(cut, schema).repartition("row", "seq")
    encoded = cut_rows.mapInArrow(leaves, schema + ", ranks binary")
    return encoded.groupBy("row").applyInPandas(join, f"key {key_type}, ids array<int>, decoded string")


def query(spark, folder: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    coded = encode(documents(spark, folder, "doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "utf-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col("decoded"), "utf-8"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_bpe_coding": (query, None)}
