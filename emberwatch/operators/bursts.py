"""Sliding counts and burst episodes over one global time line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.carry import carry_last
from emberwatch.session import run_dir, written

TIE_SLICE = 100_000
BUCKET_US = 60_000_000


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join by equal values, NULL being equal to NULL."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]
    return left.join(renamed, same).drop(*[f"_r_{c}" for c in on])


def sliding_count(
    events: DataFrame, at: str, tie: str, window_us: int, keys: list[str] | None = None, bucket_us: int = BUCKET_US
) -> DataFrame:
    """Add ``window_count``, the events in the last ``window_us`` up to and including each event.

    The lower bound is inclusive; events of the same time count in ``tie`` order (a unique BIGINT).
    A window over the time line would be one task, so the count is a difference of two positions on
    it: the event's own, and that of a probe ``window_us`` earlier. Positions are counted within time
    buckets, whose openings come from a one-row-per-bucket summary. What is sorted are counts per
    distinct time, and a time shared by very many events is cut by ``tie``: no bucket grows with the
    data, whatever the window's width.
    """
    keys = keys or []
    sliced = events.withColumn("_slice", F.expr(f"{tie} div {TIE_SLICE}"))
    place = [*keys, at, "_slice"]
    counts = sliced.groupBy(*place).agg(F.count("*").alias("_n"))
    none = F.lit(0).cast("bigint")
    marks = counts.select(*place, F.inline(F.array(
        F.struct(F.col(at).alias("_t"), F.col("_slice").alias("_s"), F.col("_n").alias("_events"), F.lit(1).alias("_sign")),
        F.struct((F.col(at) - window_us).alias("_t"), F.lit(-1).cast("bigint").alias("_s"), none.alias("_events"),
                 F.lit(-1).alias("_sign")),
    ))).withColumn("_bucket", F.expr(f"_t div {bucket_us}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    openings = marks.groupBy(*keys, "_bucket").agg(F.sum("_events").alias("_total")).select(
        *keys, "_bucket", F.coalesce(F.sum("_total").over(earlier), none).alias("_opening")
    )
    positions = _joined(marks.withColumn("_inside", F.coalesce(F.sum("_events").over(inside), none)), openings, [*keys, "_bucket"])
    before = positions.groupBy(*place).agg(
        F.sum((F.col("_opening") + F.col("_inside")) * F.col("_sign")).alias("_before")
    )
    ranked = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy(*place).orderBy(tie)))
    return (
        _joined(ranked, before, place)
        .withColumn("window_count", F.col("_before") + F.col("_rank"))
        .drop("_slice", "_rank", "_before")
    )


def episodes(flagged: DataFrame, at: str, tie: str, rearm_us: int, block_us: int = 3_600_000_000) -> DataFrame:
    """Flagged events to episodes; a pause longer than ``rearm_us`` starts a new one.

    ``flagged`` has ``reason`` and ``window_count``. The signal of an episode is that of its first
    event: ``started_at, event_id, reason, burst_count``, plus ``n_events`` and ``ended_at``.
    """
    # Flagged events are few and used several times; without this every use would count all again.
    flagged = written(flagged, run_dir(flagged.sparkSession, "flagged"))
    with_previous = carry_last(flagged, [], at, tie, F.col(at), "_previous", block_us)
    starts = F.col("_previous").isNull() | (F.col(at) - F.col("_previous") > rearm_us)
    marked = with_previous.withColumn("_start", F.when(starts, F.struct(at, tie)))
    placed = carry_last(marked, [], at, tie, F.col("_start"), "_episode", block_us, include_current=True)
    first = F.struct(at, tie)
    return placed.groupBy("_episode").agg(
        F.min(at).alias("started_at"),
        F.min_by(tie, first).alias("event_id"),
        F.min_by("reason", first).alias("reason"),
        F.min_by("window_count", first).alias("burst_count"),
        F.count("*").alias("n_events"),
        F.max(at).alias("ended_at"),
    ).drop("_episode")
