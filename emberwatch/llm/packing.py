"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

A round range-sorts what is left of documents together with the gaps of open sequences, largest first. Each range is swept
once: a document takes the nearest gap before it, which is the smallest free one that holds it. What finds no mate in its own range
is matched across ranges by rank, from the counts of each range alone. Then gaps are updated and the next round begins.
Documents without any gap open new sequences, but only as many as they would fill without waste; the others wait for the
gaps these leave. Rounds go down by halves of size: documents of up to half a size wait until all larger ones are placed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.llm.byte_pairs import byte_ids
from emberwatch.llm.shared import documents, kept

CAPACITY = 1024
END_ID = 2
#: Rows of one sweep task; the number of ranges follows from it.
SWEEP_ROWS = 50_000
#: Pieces up to this length are first joined to bundles of at most twice the length, which bounds the number of rounds.
TINY = 32


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: (id_col, piece, start, length, ids_crc32, ids binary).

    A document is its ids and then end_id; a null text has no ids. Only longer ones than capacity are cut, into pieces of
    that length after a first one that may be shorter. ``ids`` are little-endian unsigned 32-bit numbers.
    Rows with null or repeated ids are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, size = [], [], 0
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*byte_ids(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    raw = ids[a:b].tobytes()
                    keys.append(row)
                    out.append((piece, a, b - a, zlib.crc32(raw), raw))
                size += len(ids)
                if size > 1 << 19 or row == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    names = ["key", "piece", "start", "length", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *columns], names)
                    keys, out, size = [], [], 0

    base = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return base.mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids_crc32 long, ids binary").withColumnRenamed("key", id_col)


def _bundle(limit: int):
    """Consecutive tiny pieces of a partition become one item, named after the first."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, size = None, 0
        for batch in batches:
            rows = []
            for uid, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if item is None or size + length > limit:
                    item, size = uid, 0
                rows.append((uid, item, size, length))
                size += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["uid", "item", "at", "length"])

    return bundle


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match inside one range. kind 0: gap, 1: document; rows come largest first, gaps first among equals.

    Gives a row for each pair, and for each row without mate its rank among those of its kind.
    """
    part = TaskContext.get().partitionId()
    stack: list[tuple[int, int]] = []
    waiting: list[tuple[int, int]] = []
    pairs: list[tuple[int, int, int, int]] = []
    for batch in batches:
        for kind, ident, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                stack.append((ident, size))
            elif stack:
                bin_id, gap = stack.pop()
                pairs.append((ident, size, bin_id, gap))
            else:
                waiting.append((ident, size))
    rows = [("pair", i, s, b, g, 0) for i, s, b, g in pairs]
    rows += [("doc", i, s, None, None, k) for k, (i, s) in enumerate(waiting)]
    rows += [("gap", None, None, b, g, k) for k, (b, g) in enumerate(stack)]
    if rows:
        columns = [*zip(*rows, strict=True)]
        arrays = [pa.array([part] * len(rows), pa.int32()), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "what", "item", "size", "bin", "gap", "rank"])


def _match_ranges(counts: list[tuple[int, int, int]]) -> tuple[list[tuple], dict[int, int]]:
    """Match what ranges left over, from (range, documents, gaps) in order.

    Returns intervals (what, part, low, high, slot, step): ranks low <= r < high have slot + step * (r - low); and for each range the
    first rank of its documents that find no gap anywhere. One row or two per range, whatever the number of documents.
    """
    stack: list[list[int]] = []
    intervals, unmatched, slot = [], {}, 0
    for part, n_docs, n_gaps in counts:
        done = 0
        while done < n_docs and stack:
            source, left = stack[-1]
            n = min(left, n_docs - done)
            intervals.append(("doc", part, done, done + n, slot, 1))
            intervals.append(("gap", source, left - n, left, slot + n - 1, -1))
            slot, done = slot + n, done + n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        unmatched[part] = done
        if n_gaps:
            stack.append([part, n_gaps])
    return intervals, unmatched


def pack(items: DataFrame, capacity: int = CAPACITY, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Place items (item long, unique; size long, 1 to capacity) into sequences: (item, sequence_id, offset).

    sequence_id is the item that opened the sequence. Equal sizes are taken in the order of item. No items: no rows.
    """
    spark = items.sparkSession
    alone = items.where(F.col("size") > capacity // 2)  # no two of these share a sequence
    placed = [alone.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = alone.where(F.col("size") < capacity).select(F.col("item").alias("bin"), (F.lit(capacity) - F.col("size")).alias("gap"))
    high = capacity // 2
    while high:
        low = high // 2 if high > 2 * TINY else 0
        docs, waiting = items.where((F.col("size") > low) & (F.col("size") <= high)).select("item", "size"), True
        while waiting:
            figures = docs.agg(F.count("*"), F.min("size")).first()
            waiting = figures[0]
            if not waiting:
                break
            usable = gaps.where(F.col("gap") >= figures[1])
            rows = usable.select(F.lit(0).alias("kind"), F.col("bin").alias("ident"), F.col("gap").alias("size")).unionByName(
                docs.select(F.lit(1).alias("kind"), F.col("item").alias("ident"), "size")
            )
            order = [F.col("size").desc(), F.col("kind"), F.col("ident")]
            ranges = -(-(waiting + usable.count()) // sweep_rows)
            ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
            swept = kept(ranged.mapInArrow(_sweep, "part int, what string, item long, size long, bin long, gap long, rank long"), "pack-sweep")
            state = kept(_updated(spark, swept, capacity), "pack-state")
            placed.append(state.where("what = 'placed'").select("item", F.col("bin").alias("sequence_id"), F.col("gap").alias("offset")))
            docs = state.where("what = 'doc'").select("item", "size")
            # Gaps below the least document of this round wait for smaller ones.
            gaps = gaps.where(F.col("gap") < figures[1]).unionByName(state.where("what = 'gap'").select("bin", "gap"))
        high = low
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def _updated(spark, swept: DataFrame, capacity: int) -> DataFrame:
    """State after a sweep: placed documents (gap: their offset), open gaps, documents that wait."""
    counted = swept.where("what != 'pair'").groupBy("part").agg(
        F.count_if(F.col("what") == "doc").alias("docs"), F.count_if(F.col("what") == "gap").alias("gaps")
    )
    counts = sorted((r.part, r.docs, r.gaps) for r in counted.collect())  # a row per range
    intervals, unmatched = _match_ranges(counts)
    firsts = spark.createDataFrame([*unmatched.items()] or [(-1, 0)], "part int, first long")
    by_rank = spark.createDataFrame(intervals or [("", -1, 0, 0, 0, 1)], "what string, part int, low long, high long, slot long, step long")
    # As many documents of at most capacity / k fill a sequence as k says; the largest open sequences, in order of range and k.
    alike = W.partitionBy("part", "fit").orderBy("rank")
    lonely = (
        swept.where("what = 'doc'").join(F.broadcast(firsts), "part").where("rank >= first")
        .withColumn("fit", F.floor(F.lit(capacity) / F.col("size")))
        .withColumn("team", F.floor((F.row_number().over(alike) - 1) / F.col("fit")))
    )
    sums = lonely.groupBy("part", "fit").agg(F.sum("size").alias("size"), F.max("team").alias("last"))
    need = sorted((r.part, r.fit, r.size, r["last"] + 1) for r in sums.collect())  # some rows per range
    left, teams = -(-sum(n[2] for n in need) // capacity), []
    for part, fit, _, count in need:
        teams.append((part, fit, min(left, count)))
        left -= teams[-1][2]
    teams = spark.createDataFrame(teams or [(-1, 0, 0)], "part int, fit long, teams long")
    lonely = lonely.join(F.broadcast(teams), ["part", "fit"])
    team = W.partitionBy("part", "fit", "team")
    opening = lonely.where("team < teams").select(
        "item", "size", F.first("item").over(team.orderBy("rank")).alias("bin"),
        (F.sum("size").over(team.orderBy("rank")) - F.col("size")).alias("offset"), F.sum("size").over(team).alias("filled"),
    )
    opened = opening.select(F.lit("placed").alias("what"), "item", "size", "bin", F.col("offset").alias("gap")).unionByName(
        opening.where("item = bin").select(
            F.lit("gap").alias("what"), F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("size"), "bin",
            (F.lit(capacity) - F.col("filled")).alias("gap"),
        )
    )
    waiting = lonely.where("team >= teams").select(
        F.lit("doc").alias("what"), "item", "size", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("gap")
    )
    slotted = (
        swept.where("what != 'pair'").join(F.broadcast(by_rank), ["what", "part"]).where("rank >= low and rank < high")
        .select("what", "item", "size", "bin", "gap", (F.col("slot") + F.col("step") * (F.col("rank") - F.col("low"))).alias("slot"))
    )
    across = (
        slotted.where("what = 'doc'").select("slot", "item", "size")
        .join(slotted.where("what = 'gap'").select("slot", "bin", "gap"), "slot").select("item", "size", "bin", "gap")
    )
    pairs = swept.where("what = 'pair'").select("item", "size", "bin", "gap").unionByName(across)
    spent = by_rank.where("what = 'gap'").groupBy("part").agg(F.min("low").alias("used_from"))
    idle = (
        swept.where("what = 'gap'").join(F.broadcast(spent), "part", "left").where("used_from is null or rank < used_from")
        .select(F.lit("gap").alias("what"), F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("size"), "bin", "gap")
    )
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(F.lit("placed").alias("what"), F.col("item"), F.col("size"), F.col("bin"), (F.lit(capacity) - F.col("gap")).alias("gap")),
                F.struct(
                    F.lit("gap").alias("what"), F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("size"), F.col("bin"),
                    (F.col("gap") - F.col("size")).alias("gap"),
                ),
            )
        ).alias("row")
    ).select("row.*")
    return both.unionByName(opened).where("what = 'placed' or gap > 0").unionByName(waiting).unionByName(idle)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
    sweep_rows: int = SWEEP_ROWS,
) -> DataFrame:
    """Cut and pack every row: pieces with sequence_id and offset.

    See cut_documents for nulls, empty and repeated rows: each is a document of at least end_id. Other columns are
    not looked at. with_ids adds the token ids of each piece.
    """
    pieces = cut_documents(docs, id_col, text_col, capacity, end_id)
    pieces = pieces if with_ids else pieces.drop("ids")
    pieces = kept(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    sizes = pieces.select("uid", "length")
    tiny = kept(sizes.where(F.col("length") <= TINY).mapInArrow(_bundle(2 * TINY), "uid long, item long, at long, length long"), "pack-bundles")
    items = sizes.where(F.col("length") > TINY).select(F.col("uid").alias("item"), F.col("length").alias("size"))
    items = items.unionByName(tiny.groupBy("item").agg(F.sum("length").alias("size")))
    placed = pack(items, capacity, sweep_rows)
    members = tiny.select("uid", "item", "at").unionByName(
        sizes.where(F.col("length") > TINY).select("uid", F.col("uid").alias("item"), F.lit(0).cast("long").alias("at"))
    )
    seats = members.join(placed, "item").select("uid", "sequence_id", (F.col("offset") + F.col("at")).alias("offset"))
    return pieces.join(seats, "uid").drop("uid")


def query(spark, folder: str) -> DataFrame:
    """All documents packed."""
    return pack_documents(documents(spark, folder, "doc_id", "text"))


QUERIES = {"op7_best_fit_packing": (query, None)}
