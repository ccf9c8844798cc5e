"""Sums over subtrees of a tree given as rows, by parallel tree contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.shared import kept


def _coin(node: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(2)) == 1


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, one total per value) of every row of tree: the value's sum (long) over the row and all rows below it.

    tree has id (any type that can be compared; no two rows share one), parent (null: a root; else the id of a row) and long values, null
    as 0. Several roots are several trees. A null id is no row. No rows if there are none.

    A round rakes all leaves, adding what they hold to their parents, then compresses chains: a node with one child left whose coin
    shows heads, while the child's shows tails, leaves, and the child hangs under the next node up, carrying what the chain holds. Rounds
    are logarithmic in the number of rows, however deep the tree. Expansion goes back through the rounds; a contracted node's total is
    that of its only child at that time and what it then held. Rows that are left get fewer by a share each round, so all rounds
    together move a multiple of the tree. A node with very many children is summed before the shuffle.
    """
    alive = tree.where("id is not null").select("id", "parent", *[F.coalesce(v, F.lit(0)).cast("long").alias(f"sum_{v}") for v in values])
    alive = kept(alive.select("*", *[F.lit(0).cast("long").alias(f"way_{v}") for v in values]), "tree")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while True:
        turn = len(rounds)
        parents = alive.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
        marked = kept(alive.join(parents, "id", "left").fillna(False, ["inner"]), "tree-marked")
        raked = marked.where("not inner").select("id", *[F.col(f"sum_{v}").alias(v) for v in values])
        if marked.where("inner").isEmpty():
            rounds.append((raked, None))
            break
        # What raked children leave with their parent, and the only other child, if there is just one.
        gain = [F.sum(F.when(~F.col("inner"), F.col(f"sum_{v}") + F.col(f"way_{v}")).otherwise(0)).alias(f"gain_{v}") for v in values]
        left = [F.count(F.when(F.col("inner"), 1)).alias("n_left"), F.min(F.when(F.col("inner"), F.col("id"))).alias("only")]
        below = marked.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(*gain, *left)
        trunk = marked.where("inner").join(below, "id").withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.col(f"gain_{v}") for v in values})
        goes = F.col("parent").isNotNull() & (F.col("n_left") == 1) & _coin(F.col("id"), turn) & ~_coin(F.col("only"), turn)
        trunk = kept(trunk.withColumn("goes", F.coalesce(goes, F.lit(False))).drop(*[f"gain_{v}" for v in values], "inner", "n_left"), "tree-trunk")
        gone = trunk.where("goes").select(
            F.col("only").alias("id"), F.col("id").alias("gone"), F.col("parent").alias("up"),
            *[F.col(f"sum_{v}").alias(f"held_{v}") for v in values], *[F.col(f"way_{v}").alias(f"behind_{v}") for v in values],
        )
        hung = kept(trunk.where("not goes").drop("goes", "only").join(gone, "id", "left"), "tree-hung")
        contracted = hung.where("gone is not null").select(
            F.col("gone").alias("id"), F.col("id").alias("via"), *[(F.col(f"held_{v}") + F.col(f"way_{v}")).alias(f"more_{v}") for v in values]
        )
        rounds.append((raked, None if contracted.isEmpty() else contracted))
        way = {f"way_{v}": F.col(f"way_{v}") + F.coalesce(F.col(f"held_{v}") + F.col(f"behind_{v}"), F.lit(0)) for v in values}
        hung = hung.withColumns(way | {"parent": F.coalesce("up", "parent")})
        alive = hung.select("id", "parent", *[f"sum_{v}" for v in values], *[f"way_{v}" for v in values])
    known: list[DataFrame] = []
    for raked, contracted in reversed(rounds):
        if contracted is not None:
            later = reduce(DataFrame.unionByName, known).withColumnRenamed("id", "via")
            back = contracted.join(later, "via").select("id", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values])
            known.append(kept(back, "tree-back"))
        known.append(raked)
    return reduce(DataFrame.unionByName, known)
