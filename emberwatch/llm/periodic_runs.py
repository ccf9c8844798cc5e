"""Stretches of a text that repeat with a period, found by block convolution.

At each dyadic scale B the words are cut into blocks of B, and a number theoretic transform gives, for every block and every distance of
that scale, the sum of squared differences between the block and the words that far behind it. Arithmetic modulo a prime is exact, so a
repeated block always gives zero; a zero is a seed, and the words themselves decide how far its period reaches. A stretch of period q and
three periods' length holds a whole block whose copy q words on is also in the stretch, for the scale with B <= q < 2 B, so none is missed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.llm.shared import WORD, documents, process_cache

#: A run has at least so many words and so many periods.
LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: The least scale; it takes all distances below 2 * BASE, whose runs have a whole block by their least length.
BASE = 8
#: 11 * 2**21 + 1, whose residues have a root of unity of order 2**21. Sums of 32 products of centred residues stay below 2**53, so
#: a transform is a product of float64 matrices without rounding.
PRIME, GENERATOR, LONGEST_TRANSFORM = 23068673, 3, 1 << 21
MOST_RADIX_BITS = 5
#: Numbers that one step of a transform works on, and words that are looked at together.
STEP, GROUP_WORDS = 1 << 18, 1 << 17

RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _centred(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME in place, between -PRIME / 2 and PRIME / 2; exact for whole numbers below 2**53."""
    x -= np.rint(x * (1.0 / PRIME)) * PRIME
    return x


def _power_table(root: int, n: int) -> np.ndarray:
    table = np.ones(1, np.int64)
    while len(table) < n:
        table = np.concatenate([table, table * pow(root, len(table), PRIME) % PRIME])
    return table[:n]


def _levels(n: int) -> list[tuple]:
    """Steps of a transform of length n: (radix, rest, matrix, its inverse, factors between this step and the next, their inverses)."""
    cache = process_cache()
    if ("transform", n) not in cache:
        bits = n.bit_length() - 1
        steps = max(1, -(-bits // MOST_RADIX_BITS))
        levels, rest = [], n
        for k in range(steps):
            radix = 1 << (bits // steps + (k < bits % steps))
            whole, rest = rest, rest // radix
            pair = []
            for sign in (1, -1):
                root = pow(GENERATOR, sign * ((PRIME - 1) // whole), PRIME)
                powers = _power_table(root, whole)
                i = np.arange(radix)
                matrix = powers[np.outer(i, i) * rest % whole]
                if sign < 0:
                    matrix = matrix * pow(radix, -1, PRIME) % PRIME
                between = powers[np.outer(i, np.arange(rest)) % whole].astype(np.float64)
                pair.append((_centred(matrix.astype(np.float64)), _centred(between)[None, :, :, None]))
            levels.append((radix, rest, pair[0][0], pair[1][0], pair[0][1], pair[1][1]))
        cache["transform", n] = levels
    return cache["transform", n]


def transform(a: np.ndarray) -> np.ndarray:
    """Number theoretic transform of each column; the order of the result is one that only inverse() needs to know."""
    n, m = a.shape
    for radix, rest, matrix, _, between, _ in _levels(n):
        a = _centred(np.matmul(matrix, a.reshape(-1, radix, rest * m)))
        if rest > 1:
            a = _centred(a.reshape(-1, radix, rest, m) * between)
    return a.reshape(n, m)


def inverse(a: np.ndarray) -> np.ndarray:
    n, m = a.shape
    for radix, rest, _, matrix, _, between in reversed(_levels(n)):
        if rest > 1:
            a = _centred(a.reshape(-1, radix, rest, m) * between)
        a = _centred(np.matmul(matrix, a.reshape(-1, radix, rest * m)))
    return a.reshape(n, m)


def zero_distances(codes: np.ndarray, block: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of a block, distance) of each block of ``block`` codes and distance from first to last - 1 whose sum of squared differences
    is zero modulo PRIME. Blocks start at multiples of ``block``; none is cut short. Equal codes always give zero."""
    lags = last - first
    width = lags + block - 1
    length = 1 << (width - 1).bit_length()
    n_blocks = max(0, (len(codes) - first) // block)
    values = _centred(np.concatenate([codes.astype(np.float64), np.zeros(last + 2 * block)]))
    squares = np.zeros(len(values) + 1, np.int64)
    np.cumsum((values * values % PRIME).astype(np.int64), out=squares[1:])
    starts, distances = [], []
    step = max(1, STEP // length)
    for at in range(0, n_blocks, step):
        m = min(step, n_blocks - at)
        s = (at + np.arange(m)) * block
        parts, windows = np.zeros((length, m)), np.zeros((length, m))
        parts[(length - np.arange(block)) % length] = values[at * block : (at + m) * block].reshape(m, block).T
        windows[:width] = np.lib.stride_tricks.sliding_window_view(values[first:], width)[s].T
        cross = inverse(_centred(transform(parts) * transform(windows)))[:lags]
        places = s[None, :] + first + np.arange(lags)[:, None]
        total = (squares[s + block] - squares[s])[None, :] + (squares[places + block] - squares[places])
        lag, k = np.nonzero(_centred(total - 2.0 * cross) == 0)
        starts.append(s[k])
        distances.append(lag + first)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(distances)


def _reach(codes: np.ndarray, at: int, end: int, distance: int, step: int) -> int:
    """From at towards end (by +1 or -1) the first place whose code differs from the one ``distance`` on, or end."""
    chunk = 64
    while at != end:
        stop = at + step * min(chunk, abs(end - at))
        low, high = (at, stop) if step > 0 else (stop + 1, at + 1)
        differs = np.flatnonzero(codes[low:high] != codes[low + distance : high + distance])
        if len(differs):
            return low + int(differs[0 if step > 0 else -1])
        at, chunk = stop, chunk * 4
    return end


def runs_of(codes: np.ndarray, bounds: np.ndarray, longest_transform: int = LONGEST_TRANSFORM) -> np.ndarray:
    """(start, end, period) of all runs of texts that stand one behind the other in codes, the longest first.

    bounds: where each text starts, and the end of the last. Distances whose scale would need more than longest_transform take several
    shorter blocks instead.
    """
    found: list[tuple[int, int, int]] = []
    sizes = np.diff(bounds)
    scale = BASE
    while len(sizes) and int(sizes.max()) >= (LEAST_LENGTH if scale == BASE else LEAST_PERIODS * scale):
        least = LEAST_LENGTH if scale == BASE else LEAST_PERIODS * scale
        part = codes[: bounds[np.searchsorted(-sizes, -least, side="right")]]
        block = min(scale, longest_transform // 4)
        seeds = []
        for first in range(1 if scale == BASE else scale, 2 * scale, 2 * block):
            seeds.append(zero_distances(part, block, first, min(first + 2 * block, 2 * scale)))
        starts, distances = (np.concatenate(x) for x in zip(*seeds, strict=True))
        text = np.searchsorted(bounds, starts, side="right") - 1
        inside = starts + block + distances <= bounds[text + 1]
        starts, distances, text = starts[inside], distances[inside], text[inside]
        order = np.lexsort((starts, distances))
        starts, distances, text = starts[order], distances[order], text[order]
        by_start = np.argsort(starts, kind="stable")
        sorted_starts = starts[by_start]
        alive = np.ones(len(starts), bool)

        def cover(start: int, end: int, period: int) -> None:
            """Seeds inside a run at a multiple of its period tell nothing new."""
            low, high = np.searchsorted(sorted_starts, (start, end))
            k = by_start[low:high]
            alive[k[(starts[k] + block + distances[k] <= end) & (distances[k] % period == 0)]] = False

        for run in found:
            cover(*run)
        reached, distance = -1, -1
        for k in np.flatnonzero(alive):
            s, d = int(starts[k]), int(distances[k])
            if not alive[k] or (d == distance and s < reached):
                continue
            low, high = int(bounds[text[k]]), int(bounds[text[k] + 1])
            end = _reach(codes, s, high - d, d, 1)
            if end < s + block:
                continue
            start = _reach(codes, s - 1, low - 1, d, -1) + 1 if s > low else s
            reached, distance = end, d
            if end + d - start >= max(LEAST_LENGTH, LEAST_PERIODS * d):
                found.append((start, end + d, d))
                cover(start, end + d, d)
        scale *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _groups(texts: list) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(place of the first, words of each text) of neighbouring texts with about GROUP_WORDS words, or of one longer text."""
    first, group, size = 0, [], 0
    for k, text in enumerate(texts):
        words = (text or "").encode().split()
        if group and size + len(words) > GROUP_WORDS:
            yield first, group
            first, group, size = k, [], 0
        group.append(words)
        size += len(words)
    if group:
        yield first, group


def _runs_of_texts(group: list[list[bytes]]) -> dict[int, np.ndarray]:
    """Text's place in the group -> its (start, end, period), for texts that have runs."""
    order = sorted((k for k, words in enumerate(group) if len(words) >= LEAST_LENGTH), key=lambda k: -len(group[k]))
    code: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    codes = np.array([c for k in order for c in map(code.__getitem__, group[k])], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(group[k]) for k in order])]).astype(np.int64)
    runs = runs_of(codes, bounds)
    text = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    return {order[t]: runs[text == t] - [bounds[t], bounds[t], 0] for t in np.unique(text)}


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stand in no run behind its first period, joined by blanks."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, group in _groups(batch.column(1).to_pylist()):
            found = _runs_of_texts(group)
            runs = np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros((0, 3), np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(found.get(k, ())) for k in range(len(group))])])
            fields = [runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]]
            listed = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"])
            )
            kept = [_collapsed(words, found[k]) if k in found else b" ".join(words) for k, words in enumerate(group)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(group)), pa.array([len(w) for w in group], pa.int64()), listed, pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "kept_text"],
            )


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, kept_text) of every row of docs; no shuffle.

    Words are runs of characters other than \\x20 and \\x09-\\x0D. runs: (start, length, period), ordered by start and period, of each
    stretch whose smallest period fits LEAST_PERIODS times, of LEAST_LENGTH words at least, that no neighbouring word extends.
    kept_text: the words that stand in no run behind its first period, joined by one blank. Null, empty and blank texts have no words and
    an empty kept_text; null ids stay; rows that are repeated are judged each, alike; other columns are left out. Memory is that of the
    row's own text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("kept_text", T.StringType())]
    )
    return rows.mapInArrow(_batches, schema).withColumnRenamed("id", id_col)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents of which every tenth, by the checksum h of its id, has a tail that repeats.

    With n words and g = floor(h / 10): words from a = g % n on go on with period 1 + floor((n - a) / (3 + g % 8)). Others, and null
    ids and texts, stay as they are.
    """
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = docs.select("doc_id", "text", check.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    chosen = chosen.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.array_join(F.expr("transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)]))"), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def query(spark, folder: str) -> DataFrame:
    """All documents, every tenth with a repeating tail: their runs and what is left."""
    found = collapse_runs(with_repeated_tails(documents(spark, folder, "doc_id", "text")))
    # The first of several runs that no other exceeds, in the order of runs.
    better = "x.length * best.period > best.length * x.period"
    found = found.withColumn("top", F.expr(f"reduce(runs, get(runs, 0), (best, x) -> if({better}, x, best))"))
    line = "concat(x.start, ',', x.length, ',', x.period, '\n')"
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.expr(f"array_join(transform(runs, x -> {line}), '')").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


QUERIES = {"op11_periodic_runs": (query, None)}
