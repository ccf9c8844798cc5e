"""T12 and T14 over tables: earliest taint as reachability along time-ordered edges.

For facts stored as rows, possibly with one snippet holding much of the table. ``edges`` has
``snippet_id, seq, target, src`` (NULL ``src``: starts taint); ``uses`` has ``snippet_id, seq, sub,
cand_pos, cand, label`` (NULL ``cand``: fires always). Work is keyed by (snippet, name), not by
snippet, so a large snippet is spread over tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from emberwatch.session import run_dir, written


def earliest_taint(edges: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """``snippet_id, name, seq``: when each name is first tainted. ``given`` names are tainted before all.

    Edges are shuffled once, into buckets by (snippet, source); each round brings the names improved in the last one to
    them and writes only what that improves. Rounds stop when nothing does; snippets without a seed are dropped before the
    first. Lineage is cut by tables in the shared folder, so lost executors cost no recomputation from the start.
    """
    folder = run_dir(edges.sparkSession, "taint")
    seeds = edges.filter("src IS NULL").select("snippet_id", F.col("target").alias("name"), "seq")
    if given is not None:
        seeds = seeds.unionByName(given.select("snippet_id", "name", F.lit(-1).cast("bigint").alias("seq")))
    first = seeds.groupBy("snippet_id", "name").agg(F.min("seq").alias("seq"))
    paths = [f"{folder}/delta-0"]
    delta = written(first, paths[0])
    # One scan of all deltas, so that every round has the same plan.
    so_far = lambda: edges.sparkSession.read.schema(first.schema).parquet(*paths)
    seeded = delta.select("snippet_id").distinct()
    steps, name = _bucketed(edges.filter("src IS NOT NULL").join(seeded, "snippet_id", "left_semi"), f"{folder}/steps")
    while True:
        frontier = delta.select("snippet_id", F.col("name").alias("src"), F.col("seq").alias("since"))
        reached = steps.join(frontier, ["snippet_id", "src"]).filter("since < seq")
        arrivals = reached.select("snippet_id", F.col("target").alias("name"), "seq", F.lit(False).alias("old"))
        known = so_far().withColumn("old", F.lit(True))
        path = f"{folder}/delta-{len(paths)}"
        delta, fresh = _round(known.unionByName(arrivals), path)
        if not fresh:
            break
        paths.append(path)
    # Its files stay in the run's folder, like those of the rounds.
    edges.sparkSession.sql(f"DROP TABLE {name}")
    return so_far().groupBy("snippet_id", "name").agg(F.min("seq").alias("seq"))


def _bucketed(steps: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Edges in buckets of (snippet, source), so that joins by these find them where they are, and their table's name."""
    spark = steps.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"taint_steps_{uuid.uuid4().hex}"
    dealt = steps.repartition(buckets, "snippet_id", "src")
    dealt.write.bucketBy(buckets, "snippet_id", "src").sortBy("snippet_id", "src").option("path", path).saveAsTable(name)
    return spark.table(name), name


def _round(taints: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Names that are new or tainted earlier than before, and how many, counted while they are written."""
    seen = Observation()
    fresh = _merged(taints).observe(seen, F.count(F.lit(1)).alias("fresh"))
    return written(fresh, path), seen.get["fresh"]


def _merged(taints: DataFrame) -> DataFrame:
    """Earliest taint of names that arrive earlier than they were known."""
    had = F.min(F.when(F.col("old"), F.col("seq")))
    merged = taints.groupBy("snippet_id", "name").agg(F.min("seq").alias("seq"), had.alias("had"))
    return merged.filter("had IS NULL OR seq < had").select("snippet_id", "name", "seq")


def firing_uses(uses: DataFrame, known: DataFrame) -> DataFrame:
    """Uses that fire, with the label of their lowest firing candidate."""
    k = known.select("snippet_id", F.col("name").alias("cand"), F.col("seq").alias("_since"))
    joined = uses.join(k, ["snippet_id", "cand"], "left")
    fires = F.col("cand").isNull() | (F.col("_since") < F.col("seq"))
    return joined.filter(fires).groupBy("snippet_id", "seq", "sub").agg(F.min_by("label", "cand_pos").alias("label"))
