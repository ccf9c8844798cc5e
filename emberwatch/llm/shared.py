"""Helpers shared by the document operators: worker caches, text blocks and written intermediate tables."""

from __future__ import annotations

import importlib.util
import os
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.session import run_dir, written

WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy step works on; longer texts are cut into overlapping pieces.
BLOCK_BYTES = 1 << 18


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies on this machine: EMBERWATCH_TOKENIZERS if set, else the installed folder."""
    folder = os.environ.get("EMBERWATCH_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker, whatever function asks for it."""
    name = "emberwatch_llm_process_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept


def kept(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, survives lost executors."""
    return written(df, run_dir(df.sparkSession, label))


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def row_key(id_col: str, text_col: str):
    """Key of a row's content. Rows that repeat id and text share it, and so share every result."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def text_blocks(column: pa.Array, overlap: int, at_space: bool = False):
    """Cut a batch of texts into blocks of about BLOCK_BYTES bytes for numpy.

    Yields (data, rows, at, own): bytes of the block with one newline after each piece; for each piece its
    row, its offset in the row's text, and (start, end) in the block. A text longer than a block comes as pieces
    that repeat ``overlap`` bytes of their predecessor, so every stretch of up to overlap + 1 bytes is
    whole in some piece; with at_space pieces end at white space if a block has any. Nulls are empty texts.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    pieces, size = [], 0
    for row in range(len(column)):
        start, end = int(offsets[row]), int(offsets[row + 1])
        at = start
        while True:
            stop = min(end, at + BLOCK_BYTES)
            if at_space and stop < end:
                stop = _space_before(data, at, stop, end)
            pieces.append((row, at - start, at, stop))
            size += stop - at
            if size >= BLOCK_BYTES:
                yield _block(data, pieces)
                pieces, size = [], 0
            if stop == end:
                break
            at = stop - overlap
    if pieces:
        yield _block(data, pieces)


def _space_before(data: np.ndarray, start: int, stop: int, end: int) -> int:
    """The last white space of data[start:stop], else the first one after, else the end."""
    while stop < end:
        part = data[start:stop]
        found = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
        if len(found) and found[-1]:
            return start + int(found[-1])
        stop = min(end, stop + BLOCK_BYTES)
    return end


def _block(data: np.ndarray, pieces: list):
    parts, bounds, place = [], [], 0
    newline = np.array([10], np.uint8)
    for _, _, start, stop in pieces:
        parts += [data[start:stop], newline]
        bounds.append((place, place + stop - start))
        place += stop - start + 1
    rows = np.array([p[0] for p in pieces], np.int64)
    at = np.array([p[1] for p in pieces], np.int64)
    return np.concatenate(parts), rows, at, np.array(bounds, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a fixed 64-bit value for each byte."""
    cache = process_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) <= n:
        base, size = 0x9E3779B97F4A7C15, max(n + 1, BLOCK_BYTES + 4096)
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        have = cache["powers"] = (*tables, mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return have


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i] = sum of value(byte j) * base**j for j < i, modulo 2**64. For spans below some 1,000 bytes, or where equal hashes do no harm:
    modulo a power of two some longer ones are equal whatever the base. Words, which may be of any length, are hashed in fields."""
    powers, _, values = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end], the same wherever the bytes stand."""
    _, inverse, _ = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Primes of the two fields in which words are hashed.
_PRIMES = (2147483647, 2147483629)


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    table = np.ones(1, np.uint64)
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), prime)) % np.uint64(prime)])
    return table[:n]


def _field_powers(n: int) -> list[tuple]:
    """For each field: its prime, powers of a base and of its inverse, and a fixed value for each byte."""
    cache = process_cache()
    have = cache.get("field powers")
    if have is None or len(have[0][1]) <= n:
        size, have = max(n + 1, BLOCK_BYTES + 4096), []
        for lane, prime in enumerate(_PRIMES):
            drawn = mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(lane)) % np.uint64(prime - 2) + np.uint64(1)
            base = int(drawn[256]) + 1
            have.append((np.uint64(prime), _power_table(base, prime, size), _power_table(pow(base, -1, prime), prime, size), drawn[:256]))
        cache["field powers"] = have
    return have


def field_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end], the same wherever the bytes stand; unequal spans of any length are unequal but by chance."""
    out = np.zeros(len(starts), np.uint64)
    for shift, (prime, powers, inverse, values) in zip((32, 0), _field_powers(len(data)), strict=True):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)] % prime, out=sums[1:])
        out |= (sums[ends] - sums[starts]) % prime * inverse[starts] % prime << np.uint64(shift)
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without \\x20 and \\x09-\\x0D; the data must end in one of these."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
    return edge[0::2], edge[1::2]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive hashes; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, width):
        total = total * np.uint64(0xA0761D6478BD642F) + hashes[j : j + n]
    return mix(total)


def least_positions(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each ``span`` consecutive hashes the position of the smallest, leftmost among equals (at 40 bits).

    Equal stretches have it at equal relative positions, so two equal stretches of hashes share what stands there.
    """
    n = len(hashes)
    if n < span:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    step = 1 << 23
    out = []
    for at in range(0, n - span + 1, step):
        part = hashes[at : at + step + span - 1]
        least = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        out.append((least & low).astype(np.int64) + at)
    return np.concatenate(out)


_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def word_blocks(column: pa.Array, lower: bool = False):
    """Word hashes of a batch of texts, in blocks of whole texts: (row of each word, hash of each word).

    Words are runs without \\x20 and \\x09-\\x0D; ``lower`` turns A-Z to a-z. Nulls have no words.
    """
    rows_kept, hashes_kept, size = [], [], 0
    for data, rows, _, bounds in text_blocks(column, 0, at_space=True):
        data = _TO_LOWER[data] if lower else data
        starts, ends = word_spans(data)
        hashes = field_hashes(data, starts, ends)
        rows_kept.append(rows[np.searchsorted(bounds[:, 1], starts, side="right")])
        hashes_kept.append(hashes)
        size += len(hashes)
        last = int(rows[-1])
        if size >= 1 << 17:
            # The last text of the block may go on in the next one.
            row, value = np.concatenate(rows_kept), np.concatenate(hashes_kept)
            cut = int(np.searchsorted(row, last))
            if cut:
                yield row[:cut], value[:cut]
            rows_kept, hashes_kept, size = [row[cut:]], [value[cut:]], 0 if cut else size
    if rows_kept:
        row, value = np.concatenate(rows_kept), np.concatenate(hashes_kept)
        if len(row):
            yield row, value
