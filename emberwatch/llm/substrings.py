"""Substring dedup by level-wise doubling of word windows.

Short windows that occur in one row only are given up; only the others are extended to twice the length, at most the length that is
judged. Short windows are looked at where they are anchors (see repeats), which every judged window has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm import repeats
from emberwatch.llm.shared import documents, kept, least_positions, row_key, window_hashes, word_blocks

WINDOW_WORDS = 13
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def first_length(width: int) -> int:
    """Length of the first level: what becomes ``width``, or more, when doubled."""
    return (width + 1) // 2


def _anchored(column: pa.Array, width: int):
    """(row, first word of the row, window starts, anchor of each window, anchor hashes, window hashes) of blocks of texts."""
    short = first_length(width)
    for row, words in word_blocks(column):
        if len(words) < width:
            continue
        begins = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
        begin = np.repeat(begins, np.diff(np.append(begins, len(row))))
        grams = window_hashes(words, short)
        anchor = least_positions(grams, width - short + 1)
        starts = np.flatnonzero(row[: len(anchor)] == row[width - 1 : width - 1 + len(anchor)])
        yield row, begin, starts, anchor[starts], grams, words


def _find(width: int):
    def find(column: pa.Array):
        for row, begin, _, anchor, grams, _ in _anchored(column, width):
            at = np.unique(anchor)
            yield row[at], at - begin[at], grams[at]

    return find


def _extend(width: int):
    """Windows of the judged length around repeated anchors, for mapInArrow over (_id, _uid, _text, ats)."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = repeats.HotWindows(width, within=False)
        for batch in batches:
            ids, uids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ats = batch.column(3)
            places, lengths = ats.values.to_numpy(), np.diff(ats.offsets.to_numpy())
            owner = np.repeat(np.arange(len(ats)), lengths).astype(np.int64)
            places = places[ats.offsets[0].as_py() :][: len(owner)].astype(np.int64)
            hot = places < 0
            key = (owner << 32) | np.where(hot, -1 - places, places)
            order = np.argsort(key)
            key, hot = key[order], hot[order]
            for row, begin, starts, anchor, grams, words in _anchored(batch.column(2), width):
                if not len(starts) or not len(key):
                    continue
                own = (row[anchor] << 32) | (anchor - begin[anchor])
                spot = np.minimum(np.searchsorted(key, own), len(key) - 1)
                sel = np.flatnonzero(key[spot] == own)
                if not len(sel):
                    continue
                w, a, is_hot = starts[sel], anchor[sel], hot[spot[sel]]
                values = window_hashes(words, width)[w]
                at, lo = (a - begin[a]).astype(np.int32), (w - begin[w]).astype(np.int32)
                r = row[w]
                some = np.flatnonzero(is_hot)
                if len(some):
                    yield from windows.add(values[some], ids[r[some]], uids[r[some]], lo[some])
                calm = np.flatnonzero(~is_hot)
                if len(calm):
                    new = np.concatenate([[True], (a[calm][1:] != a[calm][:-1]) | (w[calm][1:] != w[calm][:-1] + 1)])
                    first = np.flatnonzero(new)
                    stops = np.append(first[1:], len(calm))
                    raw = values[calm].tobytes()
                    payload = [raw[8 * s : 8 * e] for s, e in zip(first.tolist(), stops.tolist(), strict=True)]
                    c = calm[first]
                    h = grams[a[c]]
                    yield repeats.grouped_batch(0, h, ids[r[c]], uids[r[c]], at[c], lo[c], payload)
        yield from windows.rest()

    return extend


def _judge(width: int):
    """Windows whose hash a row of a smaller d has too. Equal windows have equal anchors, so groups can be judged at once."""

    def judge(h, d, at, lo, payloads):
        offsets = np.frombuffer(payloads.buffers()[1], np.int32)[payloads.offset : payloads.offset + len(payloads) + 1] // 8
        values = np.frombuffer(payloads.buffers()[2], np.uint64)[offsets[0] : offsets[-1]]
        count = np.diff(offsets)
        row = np.repeat(np.arange(len(h)), count)
        start = lo[row] + (np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], count))
        order = np.lexsort((d[row], values))
        v = values[order]
        heads = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
        first = np.repeat(d[row[order[heads]]], np.diff(np.append(heads, len(v))))
        flags = np.zeros(len(row), bool)
        flags[order] = d[row[order]] > first
        return repeats.intervals(flags, row, start, width)

    return judge


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """Each row without the words of windows that also start in a row with a smaller id.

    Returns (id_col, text_col as given, n_words long, n_removed long, removed array<struct<s, e>> in words, kept_text: the kept words
    joined by blanks), one row per input row. Windows are judged on the input. Null and empty texts have no words. Rows with a
    null id are kept whole and make no other row lose words; rows of one id do not make each other lose words. Other columns are not
    looked at.
    """
    base = repeats.comparable(docs, id_col, text_col)
    find = _find(width)
    hot = repeats.hot_anchors(base, find)
    ats = kept(repeats.repeated_anchors(base, find, hot, within=False), "substring-anchors")
    found = base.join(ats, F.col("_id") == F.col("d")).select("_id", row_key("_id", "_raw"), repeats.whole_text(), "ats")
    spans = repeats.first_groups(found.mapInArrow(_extend(width), repeats.GROUPED), _judge(width), width, within=False)
    joined = repeats.with_spans(docs, base, spans, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    cut = joined.mapInArrow(_cut, f"_given {kind}, _raw string, n_words long, n_removed long, removed array<struct<s: int, e: int>>, kept_text string")
    return cut.withColumnsRenamed({"_given": id_col, "_raw": text_col})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, start, out = 0, 0, []
        for k, (text, spans) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            words = _WORD.findall(text.as_py() or "")
            merged: list[list[int]] = []
            for span in sorted((x["s"], x["e"]) for x in spans.as_py() or []):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append([*span])
            left, place = [], 0
            for s, e in merged:
                left += words[place:s]
                place = e
            left += words[place:]
            out.append((len(words), len(words) - len(left), [{"s": s, "e": e} for s, e in merged], " ".join(left)))
            size += len(out[-1][3])
            if size > 1 << 22 or k == batch.num_rows - 1:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.string())
                own = batch.slice(start, k + 1 - start)
                arrays = [own.column(0), own.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["_given", "_raw", "n_words", "n_removed", "removed", "kept_text"])
                size, start, out = 0, k + 1, []


def query(spark, folder: str) -> DataFrame:
    """All documents without words that repeat from earlier ones."""
    out = remove_repeats(documents(spark, folder, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


# The contract over all windows and pairs, for small tables.
SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS said FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY said) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM again),
each AS (SELECT doc_id, words[place] AS word, place FROM (SELECT *, unnest(range(1, len(words) + 1)) AS place FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS said, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

QUERIES = {"op8_substring_dedup": (query, SQL)}
