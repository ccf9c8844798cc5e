"""Byte-level dedup with suffix orders built column by column over collections of strings.

Strings of one anchor (see repeats) are a collection, aligned at the anchor. Construction goes from the last column to the first: each
round puts one more symbol before every string's suffix, and the new order and the common prefixes of neighbours follow from
the symbols, the old order and the old common prefixes alone. Neighbours with a common prefix of the judged length start with the same
window. Anchors split the collection so that rounds are as many as a window is long, not as the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm import repeats
from emberwatch.llm.shared import documents, kept, least_positions, mix, prefix_hashes, row_key, span_hashes, text_blocks

WINDOW_BYTES = 100
ANCHOR_BYTES = 24
#: An anchor in more rows than this is taken only where a window has no rarer one; which ones are is estimated and changes no result.
#: One text in COMMON_SAMPLE is counted for it.
COMMON_ROWS, COMMON_SAMPLE = 1_000, 256


def suffix_rounds(table: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rounds of the construction over rows of bytes, row r ending before column ends[r].

    Yields (column, order, common) from the last column to the first: rows by their suffix from that column on, ties in the order of rows;
    common[i] is the length of the prefix that order[i] shares with order[i - 1].
    """
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = {}
    for column in np.unique(ends):
        begins[int(column)] = np.flatnonzero(ends == column)
    for column in range(table.shape[1] - 1, -1, -1):
        fresh = begins.get(column + 1)
        if fresh is not None:  # empty suffixes come first
            order = np.concatenate([fresh, order])
            common = np.concatenate([np.zeros(len(fresh), np.int64), common])
        if not len(order):
            continue
        symbols = table[order, column]
        moved = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[moved]
        heads = np.concatenate([[0], np.flatnonzero(sorted_symbols[1:] != sorted_symbols[:-1]) + 1, [len(moved)]])
        longer = np.zeros(len(moved), np.int64)
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            if b - a > 1:  # least common prefix between the old places of neighbours
                old = moved[a:b]
                longer[a + 1 : b] = 1 + np.minimum.reduceat(common[old[0] + 1 : old[-1] + 1], old[:-1] - old[0])
        order, common = order[moved], longer
        yield column, order, common


def _find(width: int, short: int, common: np.ndarray):
    def find(column: pa.Array):
        for row, at, anchor, grams, _, _ in _anchored(column, width, short, common):
            new = np.flatnonzero(np.diff(anchor, prepend=-1))
            yield row[new], at[new], grams[anchor[new]]

    return find


def _all_anchors(short: int):
    """Every place that could be an anchor, once per hash and text."""

    def find(column: pa.Array):
        for data, rows, _, bounds in text_blocks(column, short - 1):
            if len(data) < short:
                continue
            prefix, at = prefix_hashes(data), np.arange(len(data) - short + 1)
            piece = np.minimum(np.searchsorted(bounds[:, 1], at, side="right"), len(bounds) - 1)
            at = at[(at >= bounds[piece, 0]) & (at + short <= bounds[piece, 1])]
            row = rows[np.searchsorted(bounds[:, 1], at, side="right")]
            h = span_hashes(prefix, at, at + short)
            _, once = np.unique(mix(h) + row.astype(np.uint64), return_index=True)
            yield row[once], at[once], h[once]

    return find


def _anchored(column: pa.Array, width: int, short: int, common: np.ndarray):
    """Per window of blocks of texts: (row, place of its anchor in the text, anchor in the block; anchor hashes, block, place of the window)."""
    for data, rows, offset, bounds in text_blocks(column, width - 1):
        n = len(data) - short + 1
        if len(data) < width:
            continue
        prefix = prefix_hashes(data)
        grams = span_hashes(prefix, np.arange(n), np.arange(n) + short)
        rank = grams >> np.uint64(1)
        rank[repeats.among(grams, common)] |= np.uint64(1 << 63)
        anchor = least_positions(rank, width - short + 1)
        place = np.arange(len(anchor))
        piece = np.searchsorted(bounds[:, 1], place, side="right")
        own = bounds[np.minimum(piece, len(bounds) - 1)]
        start = np.flatnonzero((place >= own[:, 0]) & (place + width <= own[:, 1]) & (piece < len(bounds)))
        piece, anchor = piece[start], anchor[start]
        shift = offset[piece] - bounds[piece, 0]
        yield rows[piece], anchor + shift, anchor, grams, data, start


def _extend(width: int, short: int, common: np.ndarray):
    """Stretches around repeated anchors, for mapInArrow over (_id, _uid, _text, ats)."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = repeats.HotWindows(width, within=True)
        for batch in batches:
            ids, uids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ats = batch.column(3)
            offsets = ats.offsets.to_numpy()
            places = ats.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
            owner = np.repeat(np.arange(len(ats)), np.diff(offsets)).astype(np.int64)
            hot = places < 0
            key = (owner << 32) | np.where(hot, -1 - places, places)
            ordered = np.argsort(key)
            key, hot = key[ordered], hot[ordered]
            for row, at, anchor, grams, data, start in _anchored(batch.column(2), width, short, common):
                if not len(start) or not len(key):
                    continue
                # One stretch per anchor: the windows that have it follow each other.
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
                stop = np.append(new[1:], len(start))
                own = (row[new] << 32) | at[new]
                spot = np.minimum(np.searchsorted(key, own), len(key) - 1)
                sel = np.flatnonzero(key[spot] == own)
                is_hot = hot[spot[sel]]
                shift = at[new] - anchor[new]
                calm = sel[~is_hot]
                if len(calm):
                    a, lo, hi = new[calm], start[new[calm]], start[stop[calm] - 1] + width
                    raw = data.tobytes()
                    payload = [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    h = grams[anchor[a]]
                    yield repeats.grouped_batch(0, h, ids[row[a]], uids[row[a]], at[a], lo + shift[calm], payload)
                some = sel[is_hot]
                if len(some):
                    prefix = prefix_hashes(data)
                    w = np.concatenate([np.arange(new[x], stop[x]) for x in some.tolist()])
                    owners = np.repeat(some, stop[some] - new[some])
                    values = span_hashes(prefix, start[w], start[w] + width)
                    yield from windows.add(values, ids[row[w]], uids[row[w]], start[w] + shift[owners])
        yield from windows.rest()

    return extend


def _judge(width: int, short: int):
    """Windows that an earlier row of the collection has too; rows come in the order in which they count as earlier."""
    before = width - short  # columns before the anchor

    def judge(h, d, at, lo, payloads):
        offsets = np.frombuffer(payloads.buffers()[1], np.int32)[payloads.offset : payloads.offset + len(payloads) + 1]
        data = np.frombuffer(payloads.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        lengths = np.diff(offsets).astype(np.int64)
        first = before - (at - lo).astype(np.int64)  # column of each row's first byte
        table = np.zeros((len(h), before + width), np.uint8)
        begin = offsets[:-1].astype(np.int64) - offsets[0]
        for a in range(0, len(h), 4096):
            rows = np.arange(a, min(a + 4096, len(h)))
            owner = np.repeat(rows, lengths[rows])
            source = np.arange(begin[a], begin[a] + len(owner))
            table[owner, first[owner] + source - begin[owner]] = data[source]
        later = np.zeros((before + 1, len(h)), bool)
        for column, order, common in suffix_rounds(table, first + lengths):
            if column > before:
                continue
            # Rows whose own bytes begin after this column have none of the windows; they stand for nothing.
            own = first[order] <= column
            heads = np.flatnonzero(np.concatenate([[True], common[1:] < width]))
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
            rank = np.where(own, order, len(h))
            least = np.minimum.reduceat(rank, heads)
            has = first[order] + lengths[order] >= column + width
            hit = own & has & (order > least[group])
            later[column, order[hit]] = True
        row, column = np.nonzero(later.T)
        start = lo[row] + (column - first[row])
        return repeats.intervals(np.ones(len(row), bool), row, start, width)

    return judge


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_BYTES, short: int = ANCHOR_BYTES
) -> DataFrame:
    """Each row's UTF-8 bytes without those of width-byte strings that also start earlier: in a row of smaller id, or further left.

    Returns (id_col, text_col as given, n_bytes long, n_removed long, removed array<struct<s, e>>: maximal runs of removed bytes,
    kept binary), one row per input row. Strings are judged on the input and never cross rows. A null text is empty. Rows with
    a null id are kept whole and count for nothing; rows that repeat an id count as one row that begins
    again, so they are judged like their own copies (equal rows lose the same bytes). Other columns are not looked at.
    """
    base = repeats.comparable(docs, id_col, text_col)
    common, rows_of = repeats.frequent_anchors(base, _all_anchors(short), COMMON_ROWS, COMMON_SAMPLE)
    hot = common[rows_of > repeats.HOT_ROWS]
    find = _find(width, short, common)
    ats = kept(repeats.repeated_anchors(base, find, hot, within=True), "suffix-anchors")
    found = base.join(ats, F.col("_id") == F.col("d")).select("_id", row_key("_id", "_raw"), repeats.whole_text(), "ats")
    spans = repeats.first_groups(found.mapInArrow(_extend(width, short, common), repeats.GROUPED), _judge(width, short), width, within=True)
    joined = repeats.with_spans(docs, base, spans, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    cut = joined.mapInArrow(_cut, f"_given {kind}, _raw string, n_bytes long, n_removed long, removed array<struct<s: int, e: int>>, kept binary")
    return cut.withColumnsRenamed({"_given": id_col, "_raw": text_col})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, start, out = 0, 0, []
        for k, (text, spans) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            raw = (text.as_py() or "").encode()
            merged: list[list[int]] = []
            for span in sorted((x["s"], x["e"]) for x in spans.as_py() or []):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append([*span])
            left, place = [], 0
            for s, e in merged:
                left.append(raw[place:s])
                place = e
            left = b"".join([*left, raw[place:]])
            out.append((len(raw), len(raw) - len(left), [{"s": s, "e": e} for s, e in merged], left))
            size += len(left)
            if size > 1 << 22 or k == batch.num_rows - 1:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.binary())
                own = batch.slice(start, k + 1 - start)
                arrays = [own.column(0), own.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["_given", "_raw", "n_bytes", "n_removed", "removed", "kept"])
                size, start, out = 0, k + 1, []


def query(spark, folder: str) -> DataFrame:
    """All documents without bytes that repeat from earlier places."""
    out = remove_repeats(documents(spark, folder, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# The contract over all windows and pairs, for small tables.
SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS code FROM documents),
strings AS (SELECT doc_id, i, md5(code[2 * i + 1:2 * i + 200]) AS said FROM (SELECT *, unnest(range(0, length(code) // 2 - 99)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY said ORDER BY doc_id, i) AS turn FROM strings) WHERE turn > 1),
edges AS (SELECT doc_id, i, i - lag(i) OVER w AS gap FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS first, max(i) + 100 AS past FROM (SELECT *, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges)
 GROUP BY doc_id, run),
between AS (SELECT doc_id, coalesce(lag(past) OVER w, 0) AS first, first AS past FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY first)
 UNION ALL SELECT doc_id, max(past), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(code[2 * first + 1:2 * coalesce(past, length(code) // 2)], '' ORDER BY first) AS code FROM between JOIN d USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(past - first) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.code) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
sha256(unhex(coalesce(k.code, d.code))) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts USING (doc_id)"""

QUERIES = {"op10_suffix_array_dedup": (query, SQL)}
