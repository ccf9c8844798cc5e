"""Greedy thinning: keep an event if the key kept none within the hold time before it.

Whether an event is kept depends on the last *kept* one, so a window over neighbours is not enough,
and one ordered walk per key would put a hot key into one task. But from each event it is known which
one would be kept next: the first at or after its release. The kept events are those that can be reached
from a key's first one.

Time is cut into blocks. A pass over the rows of each (key, block) follows the events among which a block can be
entered, those of its first hold, to where they leave it; so a block leaves a few pointers from event to
event. Ways begin where a key has been silent for a hold. Pointers are doubled in join rounds, as many as the logarithm of the
longest stretch of blocks without such a silence, which give the events at which each block is entered, and a second pass
follows these through their blocks. Rows are dealt by (key, block) and nothing is collected.

Resets (for instance a revoked credential) end a hold early: an event after the reset is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.operators.carry import carry_last
from emberwatch.session import run_dir, written

ENTRY, POINT = 0, 1


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order, cut only where a group begins (``_pos`` is 1)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("_pos").to_numpy() == 1)
        if len(begins):
            if held or begins[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
            held = []
            batch = batch.slice(begins[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class _Blocks:
    """Points of whole groups on one line: a group's times, from its block's start, follow those of the group before."""

    def __init__(self, rows: pa.Table, group: np.ndarray, width: int) -> None:
        self.stride, self.group = width + 1, group
        start = rows.column("_block").to_numpy() * width
        self.at = group * self.stride + rows.column("_at").to_numpy() - start
        free = np.minimum(rows.column("_free").to_numpy() - start, width)
        n = len(self.at)
        self.ends = np.append(np.flatnonzero(np.diff(group)) + 1, n) if n else np.zeros(0, np.int64)
        following = np.searchsorted(self.at, group * self.stride + free)
        inside = following < self.ends[np.searchsorted(self.ends, np.arange(n), side="right")] if n else following < 0
        #: The point kept after each, if it is in the same block; else the number of points.
        self.next = np.append(np.where(inside, following, n), n)

    def leaving(self) -> np.ndarray:
        """The last point of each point's way through the block."""
        n = len(self.at)
        last, ahead = np.arange(n + 1), self.next
        while (ahead < n).any():
            last = np.where(ahead < n, last[ahead], last)
            ahead = ahead[ahead]
        return last[:n]

    def enterable(self, longest: int) -> np.ndarray:
        """Points at which a block can be entered: the first of each time in its first hold, and the first after that."""
        n = len(self.at)
        if not n:
            return np.zeros(0, bool)
        early = self.at - self.group * self.stride < longest
        before = np.append(-1, np.arange(n - 1))
        begins = np.append(True, self.group[1:] != self.group[:-1])
        first_late = ~early & (begins | early[before])
        return (early | first_late) & (begins | (self.at != self.at[before]))


def _groups(rows: pa.Table) -> np.ndarray:
    return np.cumsum(rows.column("_pos").to_numpy() == 1)


def _leaving(width: int, longest: int) -> Callable:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            blocks = _Blocks(rows, _groups(rows), width)
            chosen = np.flatnonzero(blocks.enterable(longest))
            out = rows.column("_free").to_numpy()[blocks.leaving()[chosen]]
            group = blocks.group[chosen]
            last = rows.column("_at").to_numpy()[blocks.ends[np.searchsorted(blocks.ends, chosen, side="right")] - 1]
            opens = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
            picked = rows.select(["_key", "_at"]).take(chosen)
            for name, values in (("_out", pa.array(out, pa.int64())), ("_last", pa.array(last, pa.int64())), ("_opens", pa.array(opens))):
                picked = picked.append_column(name, values)
            yield from picked.combine_chunks().to_batches()

    return of_batches


def _walked(width: int) -> Callable:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            group = _groups(rows)
            is_entry = rows.column("_kind").to_numpy() == ENTRY
            entry_groups, entered = group[is_entry], rows.filter(pa.array(is_entry))
            points = rows.filter(pa.array(~is_entry))
            blocks = _Blocks(points, group[~is_entry], width)
            offset = entered.column("_at").to_numpy() - entered.column("_block").to_numpy() * width
            at = np.searchsorted(blocks.at, entry_groups * blocks.stride + offset)
            kept = np.zeros(len(blocks.at) + 1, bool)
            while len(at := at[at < len(blocks.at)]):
                kept[at] = True
                at = blocks.next[at]
            yield from points.filter(pa.array(kept[:-1])).select(["_key", "_at", "_tie"]).combine_chunks().to_batches()

    return of_batches


def _counted(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """A written table and how many rows it has."""
    seen = Observation()
    table = written(rows.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return table, seen.get["n"]


def _reached(starts: DataFrame, pointers: DataFrame, folder: str) -> DataFrame:
    """``_key, _at`` of the starts, which lie in the folder, and all points on the ways from them, by doubling ``_key, _at, _to``; no way
    leads to a start."""
    paths = [f"{folder}/starts"]
    so_far = lambda: pointers.sparkSession.read.schema(starts.schema).parquet(*paths)
    jumps = pointers
    while True:
        # As many points again: those that lie as many steps further as were found so far.
        path = f"{folder}/reached-{len(paths)}"
        _, more = _counted(so_far().join(jumps, ["_key", "_at"]).select("_key", F.col("_to").alias("_at")), path)
        if not more:
            return so_far()
        paths.append(path)
        further = jumps.select("_key", F.col("_at").alias("_to"), F.col("_to").alias("_then"))
        doubled = jumps.join(further, ["_key", "_to"]).select("_key", "_at", F.col("_then").alias("_to"))
        jumps, left = _counted(doubled, f"{folder}/jumps-{len(paths)}")
        if not left:
            return so_far()


def _next_at_or_after(rows: DataFrame, marks: DataFrame, at: str, name: str, width: int) -> DataFrame:
    """``rows`` with ``name``: the first time of ``marks`` (``_key, _at``) of the key at or after its ``at``; on time run backwards, the last."""
    # The carrying has columns of its own names.
    ahead = marks.select(F.col("_key").alias("_of"), (-F.col("_at")).alias("_back"), F.lit(0).alias("_order"), F.col("_at").alias("_mark"))
    asked = rows.withColumns({"_back": -F.col(at), "_order": F.lit(1)}).withColumnRenamed("_key", "_of")
    both = ahead.unionByName(asked, allowMissingColumns=True)
    carried = carry_last(both, ["_of"], "_back", "_order", F.col("_mark"), name, width)
    return carried.where("_order = 1").withColumnRenamed("_of", "_key").select(*rows.columns, name)


def kept_points(
    events: DataFrame, keys: list[str], at: str, tie: str, hold_us: int | Column,
    resets: DataFrame | None = None, block_holds: int = 256, longest_us: int | None = None,
) -> DataFrame:
    """``keys, at, tie`` of the events kept by greedy thinning per key.

    ``at`` is a microsecond BIGINT and ``tie`` orders events of the same time; without a time an event is not kept. An event
    exactly ``hold_us`` after the last kept one is kept. ``hold_us`` may be a column, the hold of an event that is kept, none longer
    than ``longest_us``; a hold of NULL or less than a microsecond is one. ``resets`` has ``keys`` and ``at``. Only these columns are
    shuffled; a task holds the times of one key in one block of ``block_holds`` longest holds.
    """
    longest = max(1, hold_us) if longest_us is None else max(1, longest_us)
    width = longest * block_holds
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    hold = F.greatest(F.lit(1), F.lit(hold_us) if isinstance(hold_us, int) else F.least(F.coalesce(hold_us, F.lit(1)), F.lit(longest))).cast("bigint")
    points = events.where(F.col(at).isNotNull()).select(key.alias("_key"), F.col(at).alias("_at"), F.col(tie).alias("_tie"), hold.alias("_hold"))
    if resets is not None:
        ends = resets.where(F.col(at).isNotNull()).select(key.alias("_key"), F.col(at).alias("_at"))
        points = _next_at_or_after(points, ends, "_at", "_reset", width)
    until = F.col("_at") + F.col("_hold")
    points = points.withColumn("_free", until if resets is None else F.least(until, F.col("_reset") + 1))
    block = F.expr(f"(_at - pmod(_at, {width}L)) div {width}L")
    points = points.select("_key", block.alias("_block"), F.lit(POINT).alias("_kind"), "_at", "_tie", "_free")
    in_block = Window.partitionBy("_key", "_block").orderBy("_kind", "_at", "_tie")
    folder = run_dir(events.sparkSession, "thin")
    kinds = points.schema
    more = [T.StructField("_out", T.LongType()), T.StructField("_last", T.LongType()), T.StructField("_opens", T.BooleanType())]
    left = points.withColumn("_pos", F.row_number().over(in_block)).mapInArrow(_leaving(width, longest), T.StructType([kinds["_key"], kinds["_at"], *more]))
    left = written(left, f"{folder}/ways")
    # A block that begins a hold or more after the last point before it is entered at its first point, whatever was kept.
    lasts = left.select(F.col("_key").alias("_of"), "_at", "_last", "_opens")
    opened = carry_last(lasts, ["_of"], "_at", "_last", F.col("_last"), "_before", width).where("_opens")
    starts = opened.where(F.col("_before").isNull() | (F.col("_at") - F.col("_before") >= longest)).select(F.col("_of").alias("_key"), "_at")
    starts = written(starts, f"{folder}/starts")
    pointers = _next_at_or_after(left.select("_key", "_at", "_out"), left, "_out", "_to", width).select("_key", "_at", "_to")
    pointers = pointers.where("_to IS NOT NULL").join(starts.withColumnRenamed("_at", "_to"), ["_key", "_to"], "left_anti")
    reached = _reached(starts, written(pointers, f"{folder}/pointers"), folder)
    entries = reached.select("_key", block.alias("_block"), F.lit(ENTRY).alias("_kind"), "_at")
    both = points.unionByName(entries, allowMissingColumns=True).withColumn("_pos", F.row_number().over(in_block))
    kept = both.mapInArrow(_walked(width), T.StructType([kinds["_key"], kinds["_at"], kinds["_tie"]]))
    return kept.select(*[F.col(f"_key.{k}").alias(k) for k in keys], F.col("_at").alias(at), F.col("_tie").alias(tie))


def thin(events: DataFrame, keys: list[str], at: str, tie: str, hold_us: int | Column, **options) -> DataFrame:
    """Rows of ``events`` kept by greedy thinning per key (see ``kept_points``).

    Wide rows are not moved through the thinning; they are picked by a semi join, which the
    optimiser broadcasts when few are kept.
    """
    points = kept_points(events, keys, at, tie, hold_us, **options)
    if set(events.columns) <= {*keys, at, tie}:
        return points.select(*events.columns)
    same = [events[c].eqNullSafe(points[c]) for c in (*keys, at, tie)]
    return events.join(points, same, "left_semi")
