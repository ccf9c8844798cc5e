"""Code length of documents under prediction by partial matching (PPM), pretrained on the documents that teach.

The context trie is a table per level: the byte strings of one length that occur, as whole numbers, with counts from the texts that
teach. A byte is counted in a shorter context only where a longer one had not had it (update exclusion), so a level's counts are numbers of
different strings one byte longer. What a byte costs after a context is stated for whole levels at a time, from the shortest up, by joins
on the string without its oldest byte. Escapes are estimated by the number of different bytes a context has had (method D: half a count
each, which their own counts give up); a shorter context then leaves out the bytes that the longer one has had (symbol exclusion).

Texts are dealt into blocks of a bounded size. A block asks once for each different string and word in it, so what is shuffled are the
different strings of blocks and, once, the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.llm.shared import documents, kept
from emberwatch.session import run_dir

#: Bytes of context; strings of one more must fit 48 bits.
ORDER, MOST_ORDER = 4, 5
#: Bytes of text in a block (a longer text is a block of its own), and bytes and texts that one numpy step works on.
BLOCK_BYTES, STEP_BYTES, STEP_TEXTS = 32 << 20, 4 << 20, 1 << 15
#: Ends a text. No word has it, so it also fills the context before the first byte.
END = b"\n"
SYMBOLS = 256


def _said(text: str | None) -> bytes:
    """Words, A-Z in lower case, joined by blanks, and the end."""
    return b" ".join((text or "").encode().lower().split()) + END


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, id, teaches, text) to (block, id, teaches, said); the blocks of a part are numbered."""
    number, size = 0, 0
    for batch in batches:
        parts, ids, teaches, texts = batch.columns
        said = [_said(x) for x in texts.to_pylist()]
        blocks = []
        for part, x in zip(parts.to_pylist(), said, strict=True):
            if size and size + len(x) > BLOCK_BYTES:
                number, size = number + 1, 0
            size += len(x)
            blocks.append((part << 32) + number)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), ids, teaches, pa.array(said, pa.binary())], ["block", "id", "teaches", "said"])


def _steps(said: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(strings of order + 1 bytes as numbers, place of each one's text) of all bytes of the texts, in steps of bounded size."""
    pieces, texts, size = [], [], 0
    for k, x in enumerate(said):
        for at in range(0, len(x), STEP_BYTES):
            before = x[at - order : at] if at else END * order
            pieces.append(before + x[at : at + STEP_BYTES])
            texts.append(k)
            size += len(pieces[-1])
            if size >= STEP_BYTES or len(pieces) >= STEP_TEXTS:
                yield _strings(pieces, texts, order)
                pieces, texts, size = [], [], 0
    if pieces:
        yield _strings(pieces, texts, order)


def _strings(pieces: list[bytes], texts: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    n = len(data) - order
    strings = np.zeros(n, np.uint64)
    for k in range(order + 1):
        strings = (strings << np.uint64(8)) | data[k : k + n]
    # A string that begins in the last bytes of a piece would run into the next one.
    whole = np.ones(len(data), bool)
    ends = np.cumsum(sizes)
    for k in range(1, order + 1):
        whole[ends - k] = False
    place = np.repeat(np.array(texts, np.int64), sizes)
    return strings[whole[:n]], place[:n][whole[:n]]


def _counter(order: int):
    """(block, teaches, said) to (block, gram, word, n): the strings and words of each block with their counts in texts that teach."""

    def emit(block, grams, counts, words):
        at = pa.array(np.full(len(grams), block, np.int64))
        yield pa.RecordBatch.from_arrays(
            [at, pa.array(grams.astype(np.int64)), pa.nulls(len(grams), pa.binary()), pa.array(counts)], ["block", "gram", "word", "n"]
        )
        at = pa.array(np.full(len(words), block, np.int64))
        told = pa.array(list(words), pa.binary())
        yield pa.RecordBatch.from_arrays([at, pa.nulls(len(words), pa.int64()), told, pa.array(list(words.values()), pa.int64())], ["block", "gram", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, grams, counts, words = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        for batch in batches:
            blocks, teaches, said = (np.asarray(batch.column(0)), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool), batch.column(2).to_pylist())
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if block is not None and blocks[a] != block:
                    yield from emit(block, grams, counts, words)
                    grams, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
                block = int(blocks[a])
                for strings, place in _steps(said[a:b], order):
                    strings = np.sort(strings << np.uint64(1) | teaches[a:b][place].astype(np.uint64))
                    edge = np.flatnonzero(np.diff(strings, prepend=~strings[:1]))
                    n = np.diff(np.append(edge, len(strings))) * (strings[edge] & np.uint64(1)).astype(np.int64)
                    both = np.concatenate([grams, strings[edge] >> np.uint64(1)])
                    grams, where = np.unique(both, return_inverse=True)
                    counts = np.bincount(where, np.concatenate([counts, n]), len(grams)).astype(np.int64)
                for x, learns in zip(said[a:b], teaches[a:b], strict=True):
                    for word in _tokens(x):
                        words[word] = words.get(word, 0) + int(learns)
        if block is not None:
            yield from emit(block, grams, counts, words)

    return count


def _tokens(said: bytes) -> list[bytes]:
    return [*said.split(), END]


def levels(grams: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Levels of the context trie from (gram, n): (gram, n) for strings of 1 to order + 1 bytes; n may be 0. Each is written. The longest
    strings are counted, shorter ones by how many different bytes come before them."""
    level = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    out = [kept(level, "lm-level")]
    for length in range(order, 0, -1):
        short = out[0].groupBy(F.col("gram").bitwiseAND((1 << 8 * length) - 1).alias("gram")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"))
        out.insert(0, kept(short, "lm-level"))
    return out


def costs(trie: list[DataFrame]) -> DataFrame:
    """(gram, cost) of the longest level: -log10 of the probability of a string's last byte after the others.

    ``first`` is the cost where the string's context is the longest one known; ``rest`` the cost after an escape from it, in shorter
    contexts without the bytes that it has had.
    """
    shorter = None
    for length, level in enumerate(trie, start=1):
        context = Window.partitionBy("context")
        rows = level.withColumn("context", F.shiftright("gram", 8))
        if shorter is None:
            rows = rows.withColumns({"n_": F.lit(0).cast("long"), "all_": F.lit(0).cast("long"), "kinds_": F.lit(0).cast("long")})
        else:
            low = shorter.select(F.col("gram").alias("suffix"), *[F.col(c).alias(f"{c}_") for c in ("n", "all", "kinds", "first", "rest")])
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (length - 1)) - 1)).join(low, "suffix")
        rows = rows.withColumns(
            {
                "all": F.sum("n").over(context),
                "kinds": F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(context),
                "known": F.sum(F.when(F.col("n") > 0, F.col("n_")).otherwise(0)).over(context),
            }
        )
        if shorter is None:
            rest, unseen = F.log10(SYMBOLS - F.col("kinds")), F.lit(float(np.log10(SYMBOLS)))
        else:
            new = F.col("kinds_") - F.col("kinds")
            among = (2 * (F.col("all_") - F.col("known"))).cast("double")
            escape = F.when(new > 0, F.log10(among / new)).otherwise(0.0)
            rest, unseen = F.when(F.col("n_") > 0, F.log10(among / (2 * F.col("n_") - 1))).otherwise(escape + F.col("rest_")), F.col("first_")
        total = (2 * F.col("all")).cast("double")
        rows = rows.withColumn("rest", rest)
        first = F.when(F.col("all") == 0, unseen).when(F.col("n") > 0, F.log10(total / (2 * F.col("n") - 1)))
        first = first.otherwise(F.log10(total / F.col("kinds")) + F.col("rest"))
        shorter = kept(rows.withColumn("first", first).select("gram", "n", "all", "kinds", "first", "rest"), "lm-costs")
    return shorter.select("gram", F.col("first").alias("cost"))


def _scorer(order: int, unknown: float, divisor: float):
    """Per block: first the costs of its strings, then the counts of its words, then its texts, which are scored."""
    shift = np.uint64(64 - 8 * (order + 1))

    def score_texts(batch_rows, keys, cost, index, logs, known):
        ids, teaches, said = batch_rows
        totals = np.zeros(len(said))
        for strings, place in _steps(said, order):
            low = int(place[0])
            packed = np.sort(strings << shift | (place - low).astype(np.uint64))
            strings = packed >> shift
            edge = np.flatnonzero(np.diff(strings, prepend=~strings[:1]))
            each = np.repeat(cost[np.searchsorted(keys, strings[edge])], np.diff(np.append(edge, len(strings))))
            place = (packed & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
            totals[low:] -= np.bincount(place, each, len(said) - low)
        sizes, found = [], []
        for x in said:
            words = _tokens(x)
            sizes.append(len(words))
            found.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        place, found = np.repeat(np.arange(len(said)), sizes), np.concatenate(found)
        base = np.bincount(place, logs[found], len(said))
        n_known = np.bincount(place, known[found], len(said)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [ids, teaches, pa.array(sizes, pa.int64()), pa.array(n_known), pa.array(base), pa.array(totals)],
            ["id", "teaches", "n_tokens", "n_known", "base_score", "score"],
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tables = None, None
        for batch in batches:
            blocks, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, parts, words, tables = blocks[a], [], [], None
                if kinds[a] == 0:
                    parts.append((np.asarray(rows.column(2)), np.asarray(rows.column(3))))
                elif kinds[a] == 1:
                    words.append((rows.column(4).to_pylist(), np.asarray(rows.column(3))))
                else:
                    if tables is None:
                        keys = np.concatenate([p[0] for p in parts]).astype(np.uint64)
                        by_key = np.argsort(keys)
                        counts = np.concatenate([w[1] for w in words])
                        index = {x: k for k, x in enumerate(x for w in words for x in w[0])}
                        tables = (keys[by_key], np.concatenate([p[1] for p in parts])[by_key], index, np.log10((counts + unknown) / divisor), counts > 0)
                        parts, words = [], []
                    yield score_texts((rows.column(5), rows.column(6), rows.column(7).to_pylist()), *tables)

    return score


def score(docs: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, smoothing: float = 0.5) -> DataFrame:
    """(id, teaches, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, learning from those where teaches is true.

    Tokens are words, A-Z in lower case, and one end. score: log10 probability of the tokens' bytes, blanks between them and the end, by
    PPM with contexts of up to ``order`` bytes. base_score: sum over tokens of log10((c + smoothing) / (N + smoothing * (V + 1))) with a
    token's count c, their number N and the number V of different ones in texts that teach; n_known counts tokens with c > 0. Null texts
    are empty and consist of the end; a null in teaches is false; ids may be null or repeated and each row is scored; equal texts score
    alike but for the order of sums. If nothing teaches, every byte costs log10(256). Other columns are left out.
    """
    if not 0 < order <= MOST_ORDER:
        raise ValueError(f"order must be 1 to {MOST_ORDER}")
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.coalesce(teaches, F.lit(False)).alias("teaches"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("id", kind), T.StructField("teaches", T.BooleanType()), T.StructField("said", T.BinaryType())])
    path = run_dir(docs.sparkSession, "lm-texts")
    rows.mapInArrow(_blocked, schema).write.option("compression", "zstd").parquet(path)
    texts = docs.sparkSession.read.schema(schema).parquet(path)
    counts = texts.select("block", "teaches", "said").mapInArrow(_counter(order), "block long, gram long, word binary, n long")
    counts = kept(counts, "lm-counts")
    grams = counts.where("gram is not null").select("block", "gram", "n")
    priced = costs(levels(grams, order))
    # One row per block and word, however frequent the word.
    same = Window.partitionBy("word")
    words = counts.where("word is not null").select("block", "word", F.sum("n").over(same).alias("c"), F.row_number().over(same.orderBy("block")).alias("turn"))
    words = kept(words, "lm-words")
    n, v = words.where("turn = 1").agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n = n or 0
    none = F.lit(None)
    first = grams.select("block", "gram").join(priced, "gram").select(
        "block", F.lit(0).alias("kind"), "gram", F.col("cost").alias("value"), none.cast("binary").alias("word"),
        none.cast(kind).alias("id"), none.cast("boolean").alias("teaches"), none.cast("binary").alias("said"),
    )
    second = words.select(
        "block", F.lit(1).alias("kind"), none.cast("long").alias("gram"), F.col("c").cast("double").alias("value"), "word",
        none.cast(kind).alias("id"), none.cast("boolean").alias("teaches"), none.cast("binary").alias("said"),
    )
    third = texts.select(
        "block", F.lit(2).alias("kind"), none.cast("long").alias("gram"), none.cast("double").alias("value"), none.cast("binary").alias("word"),
        "id", "teaches", "said",
    )
    asked = first.unionByName(second).unionByName(third).repartition("block").sortWithinPartitions("block", "kind")
    out = T.StructType([T.StructField(id_col, kind), T.StructField("teaches", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
                        *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    scored = asked.mapInArrow(_scorer(order, smoothing, n + smoothing * (v + 1)), out)
    return scored.select(id_col, "teaches", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, folder: str) -> DataFrame:
    """All documents; those whose id's checksum leaves 1 when divided by 5 do not teach."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scored = score(documents(spark, folder, "doc_id", "text"), ~held_out)
    return scored.select("doc_id", (~F.col("teaches")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op13_lm_scoring": (query, None)}
