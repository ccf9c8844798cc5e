"""Process snapshots: restarts, memory, status report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import SECOND
from emberwatch.operators.carry import carry_last
from emberwatch.operators.thinning import thin

# Memory alert threshold and cooldown.
MEMORY_THRESHOLD_MB = 1024
MEMORY_COOLDOWN_SECONDS = 300
_MB = 1024 * 1024


def restarts(snapshots: DataFrame, at: str = "at_us", block_us: int = 3_600_000_000) -> DataFrame:
    """Snapshots whose restart counter rose since the process's last one, if that was positive."""
    paired = carry_last(snapshots, ["name"], at, "snapshot_id", F.col("restarts"), "previous_restarts", block_us)
    return paired.filter((F.col("previous_restarts") > 0) & (F.col("restarts") > F.col("previous_restarts")))


def high_memory(snapshots: DataFrame, threshold_mb: int = MEMORY_THRESHOLD_MB) -> DataFrame:
    """Snapshots at or above the threshold."""
    return snapshots.filter(F.col("mem_bytes") >= threshold_mb * _MB)


def memory_alerts(
    snapshots: DataFrame, at: str = "at_us", threshold_mb: int = MEMORY_THRESHOLD_MB,
    cooldown_seconds: int = MEMORY_COOLDOWN_SECONDS,
) -> DataFrame:
    """High-memory snapshots thinned by the alert cooldown of their process."""
    return thin(high_memory(snapshots, threshold_mb), ["name"], at, "snapshot_id", cooldown_seconds * SECOND)


def latest(snapshots: DataFrame, at: str = "at_us") -> DataFrame:
    """The last snapshot of each process; pre-aggregated, so a busy process costs no more."""
    rest = [c for c in snapshots.columns if c != "name"]
    newest = snapshots.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct(at, "snapshot_id")).alias("s"))
    return newest.select("name", "s.*")


def status_line(name: Column, status: Column, restart_count: Column, mem_bytes: Column) -> Column:
    """Icon, name, state, restarts and whole megabytes of one process."""
    icon = F.when(status == "online", "🟢").when(status == "stopped", "🔴").otherwise("🟡")
    memory = F.when(mem_bytes == 0, "?").otherwise(
        F.concat(F.shiftright(mem_bytes.cast("bigint"), 20).cast("string"), F.lit("MB"))
    )
    return F.concat(
        icon, F.lit(" <b>"), name, F.lit("</b> — "), status, F.lit(", ↺"), restart_count.cast("string"), F.lit(", "), memory
    )


def restart_notice(restart_count: Column, status: Column, mem_bytes: Column) -> Column:
    """Text of a restart alert, memory rounded half to even."""
    megabytes = F.bround(mem_bytes / F.lit(_MB), 0).cast("bigint").cast("string")
    return F.concat(
        F.lit("<b>Restart #:</b> "), restart_count.cast("string"), F.lit("\n<b>Status:</b> "), status,
        F.lit("\n<b>Memory now:</b> "), megabytes, F.lit(" MB"),
    )


def stop_notice(reason: Column, count: Column, window_seconds: Column) -> Column:
    """Text of a stop, with the defaults of a damaged signal."""
    return F.concat(
        F.lit("<b>Reason:</b> "), F.coalesce(reason, F.lit("unknown")), F.lit("\n<b>Burst:</b> "),
        F.coalesce(count.cast("string"), F.lit("?")), F.lit(" errors in "),
        F.coalesce(window_seconds.cast("string"), F.lit("?")), F.lit("s"),
    )
