"""Service health: sample gate, failure window and the restart budget."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import SECOND
from emberwatch.operators.bursts import sliding_count
from emberwatch.operators.thinning import thin

# Cadence and limits of the health check, in seconds and counts.
CHECK_SECONDS = 12
FAIL_WINDOW_SECONDS = 60
FAIL_THRESHOLD = 5
RESTART_COOLDOWN_SECONDS = 120
MAX_RESTARTS = 3
HEALTHY_RESET_SECONDS = 600
HEALTHY = "connected"


@dataclass(frozen=True)
class Budget:
    """Limits of the restart machine, times in microseconds."""

    check: int = CHECK_SECONDS * SECOND
    window: int = FAIL_WINDOW_SECONDS * SECOND
    threshold: int = FAIL_THRESHOLD
    cooldown: int = RESTART_COOLDOWN_SECONDS * SECOND
    max_restarts: int = MAX_RESTARTS
    healthy_reset: int = HEALTHY_RESET_SECONDS * SECOND


@dataclass
class Service:
    """State of one service between samples; ``next_at`` is when a sample counts again."""

    next_at: int = 0
    healthy_since: int = 0
    restarts: int = 0
    shut: bool = False
    fails: list[int] = field(default_factory=list)

    def take(self, at: int, status: str | None, limits: Budget) -> tuple[str, int] | None:
        """Account for one sample that is due; return the event it causes and the restart count."""
        self.next_at = at + limits.check
        if status is None:
            return None
        if status == HEALTHY:
            stable = self.healthy_since and at - self.healthy_since >= limits.healthy_reset
            self.healthy_since = self.healthy_since or at
            if stable and self.restarts:
                self.restarts, self.fails = 0, []
                return "RECOVERED", 0
            return None
        self.healthy_since = 0
        self.fails = [t for t in self.fails if t >= at - limits.window] + [at]
        if len(self.fails) < limits.threshold:
            return None
        self.fails = []
        if self.restarts >= limits.max_restarts:
            self.shut = True
            return "SHUTDOWN", self.restarts
        self.restarts += 1
        self.next_at = max(self.next_at, at + limits.cooldown)
        return "RESTART", self.restarts


def _events(limits: Budget):
    """Fold ordered batches; samples that are not due are skipped by binary search, not one by one."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Service()
        for batch in batches:
            out = []
            names, times = batch["service"].to_numpy(), batch["at_us"].to_numpy()
            ids, status = batch["sample_id"].to_numpy(), batch["status"].to_numpy()
            edges = [0, *((names[1:] != names[:-1]).nonzero()[0] + 1).tolist(), len(names)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                if names[start] != current:
                    current, state = names[start], Service()
                i = start
                while not state.shut:
                    i += int(times[i:end].searchsorted(state.next_at))
                    if i >= end:
                        break
                    event = state.take(int(times[i]), status[i], limits)
                    if event:
                        out.append((current, int(ids[i]), int(times[i]), *event))
                    i += 1
            yield pd.DataFrame(out, columns=["service", "sample_id", "at_us", "event", "restarts"])

    return fold


def gate(samples: DataFrame, at: str = "at_us", seconds: int = CHECK_SECONDS) -> DataFrame:
    """At most one sample of a service per check interval."""
    return thin(samples, ["service"], at, "sample_id", seconds * SECOND)


def failure_windows(
    samples: DataFrame, at: str = "at_us", seconds: int = FAIL_WINDOW_SECONDS, threshold: int = FAIL_THRESHOLD
) -> DataFrame:
    """P5: unhealthy samples with the failures of their service in the window, and the trigger flag."""
    failed = samples.filter(F.col("status").isNotNull() & (F.col("status") != HEALTHY))
    counted = sliding_count(failed, at, "sample_id", seconds * SECOND, keys=["service"])
    return counted.withColumn("triggers", F.col("window_count") >= threshold)


def restart_events(samples: DataFrame, limits: Budget | None = None) -> DataFrame:
    """RESTART, SHUTDOWN and RECOVERED events of each service.

    ``samples`` has ``service, sample_id, at_us, status`` (NULL status: the fetch failed). The state of a
    service after a sample depends on all before it, so a service is walked in order; its rows are
    streamed through one task in Arrow batches and never collected, with one small state at a time.
    """
    rows = samples.select("service", "sample_id", "at_us", "status")
    ordered = rows.repartition("service").sortWithinPartitions("service", "at_us", "sample_id")
    schema = "service string, sample_id bigint, at_us bigint, event string, restarts int"
    return ordered.mapInPandas(_events(limits or Budget()), schema)
