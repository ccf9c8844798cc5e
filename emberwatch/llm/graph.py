"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.shared import kept


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, root long) of every node that has an edge; root is the least node of its component.

    Union by stars: each node hangs its greater neighbours, then its lesser ones, under the least it knows, until every
    component is one star. Nulls and loops are no edges. A round is two grouped sums and two joins; a node with very many
    neighbours is summed before the shuffle, and its rows may be split in the joins. No rows if there are no edges.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    stars = kept(pair.where("u > v").distinct(), "stars")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lesser = hung.groupBy("u").agg(F.min("v").alias("m"))
        small = hung.join(lesser, "u")
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lesser.select("u", F.col("m").alias("v")))
        stars = kept(stars.where("u > v").distinct(), "stars")
        after = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            break
        before = after
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
