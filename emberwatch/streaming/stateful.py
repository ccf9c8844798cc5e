"""Streaming forms of the stateful operators.

Rows count in event-time order within a micro-batch; across batches they are taken as they arrive.
State of keys that can no longer matter is dropped once the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberwatch.functions.text import SECOND, micros
from emberwatch.operators.alerts import BURST_THRESHOLD, BURST_WINDOW_SECONDS, COOLDOWN_SECONDS
from emberwatch.operators.health import Budget, Service
from emberwatch.streaming.runner import use_rocksdb

#: How late an event may come by default. Later ones are dropped by the stream, so set it to the delay that the source can have.
WATERMARK = "10 minutes"


def _gather(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """A key's rows of one micro-batch in event-time order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")


class _Cooldown(StatefulProcessor):
    """Keeps the time a fingerprint was last alerted."""

    def __init__(self, hold_us: int):
        self.hold_us = hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _gather(rows, "at_us", "event_id")
        times = batch["at_us"].to_numpy()
        free = self.last.get()[0] + self.hold_us if self.last.exists() else np.iinfo(np.int64).min
        kept = []
        place = int(np.searchsorted(times, free))
        while place < len(times):
            kept.append(place)
            place = int(np.searchsorted(times, times[place] + self.hold_us))
        if kept:
            last = int(times[kept[-1]])
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.hold_us) // 1000 + 1)
        yield batch.iloc[kept][["event_id", "at_us", "fingerprint"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def cooldown(classified: DataFrame, seconds: int = COOLDOWN_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """Alertable failures of a stream after the cooldown of their fingerprint.

    ``classified`` has ``event_id, ts, fingerprint, label``.
    """
    use_rocksdb(classified.sparkSession)
    rows = classified.filter(F.col("label").isNotNull()).select(
        "event_id", "fingerprint", micros("ts").alias("at_us"), F.col("ts").cast("timestamp").alias("event_time")
    )
    return rows.withWatermark("event_time", watermark).groupBy("fingerprint").transformWithStateInPandas(
        statefulProcessor=_Cooldown(seconds * SECOND),
        outputStructType="event_id bigint, at_us bigint, fingerprint string",
        outputMode="append",
        timeMode="EventTime",
    )


class _WindowCount(StatefulProcessor):
    """Keeps the event times one time bucket has seen, its own and those of the bucket before."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = np.sort(np.array([t[0] for t in self.times.get()], dtype=np.int64)) if self.times.exists() else np.array([], dtype=np.int64)
        batch = _gather(rows, "at_us", "event_id")
        fresh = batch["at_us"].to_numpy()
        if not len(seen):
            self.handle.registerTimer((int(key[0]) + 2) * self.window_us // 1000)
        self.times.appendList([(int(t),) for t in fresh])
        # Earlier events that arrived before, and those before it in this batch, itself included.
        before = np.searchsorted(seen, fresh, side="right") - np.searchsorted(seen, fresh - self.window_us)
        inside = np.arange(1, len(fresh) + 1) - np.searchsorted(fresh, fresh - self.window_us)
        batch["window_count"] = before + inside
        yield batch.loc[batch["own"], ["event_id", "at_us", "window_count"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def burst_counts(
    classified: DataFrame, window_seconds: int = BURST_WINDOW_SECONDS, threshold: int = BURST_THRESHOLD, watermark: str = WATERMARK,
) -> DataFrame:
    """Exact sliding counts of alertable failures of a stream, with the burst flag.

    State is keyed by time bucket and each event also goes to the bucket after its own, so the count
    over all failures is not one task's work.
    """
    use_rocksdb(classified.sparkSession)
    window_us = window_seconds * SECOND
    at = micros("ts")
    bucket = F.floor(at / window_us).cast("bigint")
    rows = classified.filter(F.col("label").isNotNull()).select(
        "event_id", at.alias("at_us"), F.col("ts").cast("timestamp").alias("event_time"),
        F.inline(F.array(
            F.struct(bucket.alias("bucket"), F.lit(True).alias("own")),
            F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")),
        )),
    )
    counted = rows.withWatermark("event_time", watermark).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_WindowCount(window_us),
        outputStructType="event_id bigint, at_us bigint, window_count bigint",
        outputMode="append",
        timeMode="EventTime",
    )
    return counted.withColumn("is_burst", F.col("window_count") >= threshold)


class _Health(StatefulProcessor):
    """Keeps the restart machine of one service."""

    def __init__(self, limits: Budget):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "service", "next_at bigint, healthy_since bigint, restarts int, shut boolean, fails array<bigint>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        service = Service()
        if self.state.exists():
            next_at, healthy_since, restarts, shut, fails = self.state.get()
            service = Service(next_at, healthy_since, restarts, shut, list(fails))
        out = []
        if not service.shut:
            batch = _gather(rows, "at_us", "sample_id")
            times, ids, status = (batch[c].to_numpy() for c in ("at_us", "sample_id", "status"))
            place = int(np.searchsorted(times, service.next_at))
            while place < len(times) and not service.shut:
                event = service.take(int(times[place]), status[place], self.limits)
                if event:
                    out.append((key[0], int(ids[place]), int(times[place]), *event))
                place = max(place + 1, int(np.searchsorted(times, service.next_at)))
            self.state.update((service.next_at, service.healthy_since, service.restarts, service.shut, service.fails))
        yield pd.DataFrame(out, columns=["service", "sample_id", "at_us", "event", "restarts"])

    def close(self) -> None:
        pass


def restart_events(samples: DataFrame, limits: Budget | None = None) -> DataFrame:
    """Restart machine over a stream of ``service, sample_id, at_us, status``."""
    use_rocksdb(samples.sparkSession)
    return samples.groupBy("service").transformWithStateInPandas(
        statefulProcessor=_Health(limits or Budget()),
        outputStructType="service string, sample_id bigint, at_us bigint, event string, restarts int",
        outputMode="append",
        timeMode="None",
    )
