"""Steps that substring operators share: anchors, the ones that repeat, groups of one anchor, and cutting out spans.

Every window of a judged length has an anchor: the shorter window in it with the least hash. Equal windows have equal anchors at the same
place, so a window can only repeat if its anchor does. Anchors are a small share of all positions, and only they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.shared import row_key

#: Windows of anchors expected in more rows than this are met in each task before they are shuffled. One row in SAMPLE is counted to
#: find them. Neither changes a result.
HOT_ROWS, SAMPLE, MOST_HOT = 20_000, 64, 1 << 14


def comparable(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id long, _raw): rows with an id. Both joins of an operator start from exactly this, so texts cross the network once."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_raw"))


def whole_text():
    return F.coalesce(F.col("_raw"), F.lit(""))


ANCHORS = "h long, d long, at int, hot boolean"


def anchor_rows(find: Callable, hot: np.ndarray):
    """A function for mapInArrow over (_id, _text). find(column) yields (row, at, hash) of the anchors of some texts."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, at, h in find(batch.column(1)):
                d = ids[row]
                is_hot = among(h, hot)
                arrays = [pa.array(h.view(np.int64)), pa.array(d, pa.int64()), pa.array(at.astype(np.int32)), pa.array(is_hot)]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "d", "at", "hot"])

    return anchors


def hot_anchors(base: DataFrame, find: Callable) -> np.ndarray:
    """Ascending hashes of anchors that very many rows have, from one row in SAMPLE."""
    return frequent_anchors(base, find, HOT_ROWS)[0]


def frequent_anchors(base: DataFrame, find: Callable, rows_from: int, sample: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes that find yields for more than about rows_from rows, and their estimated rows; the MOST_HOT first ones."""
    sample = sample or SAMPLE
    part = base.where(F.pmod(F.xxhash64("_id"), F.lit(sample)) == 0).select("_id", whole_text())
    rows = part.mapInArrow(anchor_rows(find, np.zeros(0, np.uint64)), ANCHORS)
    counts = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") * sample > rows_from)
    top = counts.orderBy(F.col("n").desc(), "h").limit(MOST_HOT).collect()
    hashes = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r.n * sample for r in top], np.int64)[order]


def among(hashes: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which hashes are in a short ascending list; most are ruled out by their first 16 bits."""
    out = np.zeros(len(hashes), bool)
    if len(few):
        begins = np.zeros(1 << 16, bool)
        begins[(few >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(begins[(hashes >> np.uint64(48)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(few, hashes[maybe]), len(few) - 1)
        out[maybe] = few[spot] == hashes[maybe]
    return out


def _repeated(within: bool):
    """Keep rows whose h has another row (within), or a row of another d. Rows come sorted by h, d; hot ones are all kept."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_h = None, None  # rows of the last run so far without a mate; the last run if it has one
        for batch in batches:
            table = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                table = [np.concatenate([a, b]) for a, b in zip(held, table, strict=True)]
            h, d, at, hot = table
            if not len(h):
                continue
            starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            ends = np.append(starts[1:], len(h))
            several = (ends - starts > 1) if within else (d[starts] != d[ends - 1])
            several |= hot[starts]
            several[0] |= open_h is not None and h[0] == open_h
            mask = np.repeat(several, ends - starts)
            held, open_h = None, None
            if several[-1]:
                open_h = h[-1]
            else:
                held = [c[starts[-1] :] for c in table]
            if mask.any():
                at = np.where(hot, -1 - at, at)
                yield pa.RecordBatch.from_arrays([pa.array(d[mask]), pa.array(at[mask].astype(np.int32))], ["d", "at"])

    return keep


def repeated_anchors(base: DataFrame, find: Callable, hot: np.ndarray, within: bool) -> DataFrame:
    """(d, ats array<int>): places of each row's anchors that occur elsewhere too; -1 - place for hot ones."""
    rows = base.select("_id", whole_text()).mapInArrow(anchor_rows(find, hot), ANCHORS)
    dealt = rows.repartition(F.when(F.col("hot"), F.xxhash64("d", "at")).otherwise(F.col("h"))).sortWithinPartitions("h", "d")
    return dealt.mapInArrow(_repeated(within), "d long, at int").groupBy("d").agg(F.sort_array(F.collect_list("at")).alias("ats"))


#: kind 0: windows of one anchor (payload), 1: a window of a hot anchor (h: its hash, lo: its place), 2: a span found already (lo to at).
GROUPED = "kind int, h long, d long, uid long, at int, lo int, payload binary"
SPANS = "d long, uid long, s int, e int"


def grouped_batch(kind: int, h, d, uid, at, lo, payload=None) -> pa.RecordBatch:
    as_int = lambda x: pa.array(np.asarray(x).astype(np.int32))
    arrays = [
        pa.array(np.full(len(h), kind, np.int32)), pa.array(np.asarray(h).view(np.int64)), pa.array(d, pa.int64()), pa.array(uid, pa.int64()), as_int(at),
        as_int(lo), pa.array([None] * len(h) if payload is None else payload, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "h", "d", "uid", "at", "lo", "payload"])


class HotWindows:
    """Windows of hot anchors that a task has met. Of equal ones only the first can stay, so all others are spans at once, and
    each task sends on one row per window (within), or those of the least d."""

    def __init__(self, width: int, within: bool, flush_rows: int = 1 << 17):
        self.width, self.within, self.flush_rows = width, within, flush_rows
        self.parts: list[tuple] = []
        self.size = self.settled = 0

    def add(self, h, d, uid, lo) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, d, uid, lo.astype(np.int64)))
        self.size += len(h)
        if self.size > 2 * self.settled + self.flush_rows:
            yield from self._settle()

    def _settle(self) -> Iterator[pa.RecordBatch]:
        h, d, uid, lo = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((lo, d, h))
        h, d, uid, lo = h[order], d[order], uid[order], lo[order]
        gone = _not_first(h, d, self.within)
        self.parts = [(h[~gone], d[~gone], uid[~gone], lo[~gone])]
        self.size = self.settled = int((~gone).sum())
        yield from _as_spans(d[gone], uid[gone], lo[gone], self.width)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._settle()
            h, d, uid, lo = self.parts[0]
            yield grouped_batch(1, h, d, uid, lo, lo)


def _not_first(h: np.ndarray, d: np.ndarray, within: bool) -> np.ndarray:
    """Rows sorted by h, d (and place) that another row of their h precedes; without ``within`` one of a smaller d."""
    heads = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    first = np.repeat(heads, np.diff(np.append(heads, len(h))))
    return np.arange(len(h)) > first if within else d > d[first]


def _as_spans(d, uid, lo, width: int) -> Iterator[pa.RecordBatch]:
    if len(d):
        order = np.lexsort((lo, uid, d))
        d, uid, lo = d[order], uid[order], lo[order]
        group = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (uid[1:] != uid[:-1])]))
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        g, s, e = intervals(np.ones(len(d), bool), group, lo, width)
        yield grouped_batch(2, np.zeros(len(g), np.int64), d[heads[g]], uid[heads[g]], e, s)


def first_groups(grouped: DataFrame, judge: Callable, width: int, within: bool, batch_rows: int = 20_000) -> DataFrame:
    """Spans to remove from rows of GROUPED; those of one h are judged together.

    judge(h, d, at, lo, payloads) gives (row, start, end) for rows sorted by h, d, at; rows of a group are never parted.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < batch_rows:
                continue
            kind, h = held.column("kind").to_numpy(), held.column("h").to_numpy()
            other = np.flatnonzero((h != h[-1]) | (kind != kind[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from _judged(held.slice(0, cut), judge, width, within)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from _judged(held, judge, width, within)

    place = F.when(F.col("kind") == 2, F.xxhash64("d", "lo")).otherwise(F.col("h"))
    return grouped.repartition(place).sortWithinPartitions("kind", "h", "d", "at").mapInArrow(spans, SPANS)


def _judged(table: pa.Table, judge: Callable, width: int, within: bool) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    kind, h, d, uid, at, lo = (table.column(c).to_numpy() for c in ("kind", "h", "d", "uid", "at", "lo"))
    done = np.flatnonzero(kind == 2)
    if len(done):
        yield _span_batch(d[done], uid[done], lo[done], at[done])
    some = np.flatnonzero(kind == 1)
    if len(some):
        gone = some[_not_first(h[some], d[some], within)]
        yield _span_batch(d[gone], uid[gone], lo[gone], lo[gone] + width)
    calm = np.flatnonzero(kind == 0)
    if len(calm):
        payloads = table.column("payload").take(pa.array(calm)).combine_chunks()
        row, s, e = judge(h[calm], d[calm], at[calm], lo[calm], payloads)
        if len(row):
            own = calm[row]
            yield _span_batch(d[own], uid[own], s, e)


def _span_batch(d, uid, s, e):
    as_int = lambda x: pa.array(np.asarray(x).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(uid, pa.int64()), as_int(s), as_int(e)], ["d", "uid", "s", "e"])


def with_spans(docs: DataFrame, base: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_given, _raw, spans array<struct<s, e>>) of every row of docs; null where there is none."""
    by_id = spans.groupBy("d").agg(F.collect_set(F.struct("uid", "s", "e")).alias("found"))
    joined = base.join(by_id, F.col("_id") == F.col("d"), "left").withColumn("_uid", row_key("_id", "_raw"))
    own = F.transform(F.filter("found", lambda x: x.uid == F.col("_uid")), lambda x: F.struct(x.s.alias("s"), x.e.alias("e")))
    kind = docs.schema[id_col].dataType
    rows = joined.select(F.col("_id").cast(kind).alias("_given"), "_raw", own.alias("spans"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col).alias("_given"), F.col(text_col).alias("_raw"))
    return rows.unionByName(nameless.withColumn("spans", F.lit(None).cast("array<struct<s: int, e: int>>")))


def intervals(flags: np.ndarray, group: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flagged windows as spans: (group, first start, last start + width) of windows whose starts follow each other in a group."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on, on
    g, s = group[on], start[on]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(on)) - 1
    return g[first], s[first], s[last] + width
