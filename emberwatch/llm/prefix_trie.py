"""The prefix trie of conversations: what they share from their first turn on, and how many tokens sharing saves.

A node is a distinct sequence of first turns. Its key is a sum over the turns of digests of (place, role, text), so the keys of all
prefixes are running sums, which may be cut anywhere: a conversation with very many turns is many tasks. Subtree totals come from
tree_contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.shared import kept
from emberwatch.llm.tree_contraction import subtree_totals

#: A key is so many sums of numbers of so many hexadecimal digits, 180 bits; 2**27 turns can be summed before one overflows.
LANES, LANE_DIGITS = 5, 9
_LANES = [f"lane_{k}" for k in range(LANES)]


def running_sums(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with each of the values replaced by its sum over the rows of the same key up to this one, by order; rows alike in key and
    order come in any order. Rows are dealt by ranges of (key, order), so a key with very many rows is several tasks, whose sums are
    carried on from a table with one row per key and range. Nulls sort first."""
    ascending = [F.col(c).asc_nulls_first() for c in order]
    # The last sort key only spreads rows that are alike.
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(F.col(key), *ascending, F.col("_row"))
    dealt = kept(dealt.withColumn("_range", F.spark_partition_id()), "running")
    here = Window.partitionBy("_range", key).orderBy(*ascending, "_row").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("_range", *[c for c in rows.columns if c not in values], *[F.sum(v).over(here).alias(v) for v in values])
    ranges = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_key", "_at", *[F.sum(f"_{v}").over(before).alias(f"_{v}") for v in values])
    ranges = ranges.where(" or ".join(f"_{v} is not null" for v in values))
    whole = local.join(ranges, (local[key] == ranges["_key"]) & (local["_range"] == ranges["_at"]), "left")
    return whole.select(*[F.col(c) if c not in values else (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in rows.columns])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, n_bytes) of every row of conversations, in the order of turn, null first; n_bytes: UTF-8 bytes of
    the text.

    Null roles and texts are empty. Rows without conv_id belong to no conversation. Rows of one turn are ordered by the digest of
    their role and text; rows that are alike are each a turn. Texts leave here: only their digests are shuffled.
    """
    role, text = (F.coalesce(c, F.lit("")).cast("binary") for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(told, 256).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("pos"),
    )
    return running_sums(rows, "conv_id", ["turn", "digest"], ["pos"]).select("conv_id", "pos", "digest", "n_bytes")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as others do, from numbered turns: (conv_id, n_turns) and turns again, numbered anew.

    The first h = crc32(conv_id) % 9 turns of c become those of c - c % 5, all of them if it has fewer; c's own turns after its first h follow.
    """
    turns = kept(turns, "turns")
    lengths = kept(turns.groupBy("conv_id").agg(F.max("pos").alias("n_own")), "lengths")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")
    convs = lengths.select("conv_id", "n_own", head, (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    convs = convs.withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = kept(convs.withColumn("n_turns", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "convs")
    first = turns.where("pos <= 8").withColumnRenamed("conv_id", "base")
    heads = first.join(convs.select("base", "conv_id", "h"), "base").where("pos <= h").select("conv_id", "pos", "digest", "n_bytes")
    tails = turns.join(convs.select("conv_id", "h", "n_head"), "conv_id").where("pos > h")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "digest", "n_bytes")
    return convs.select("conv_id", "n_turns"), heads.unionByName(tails)


def _lanes() -> dict[str, Column]:
    digest = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "digest").cast("binary"), 256)
    return {x: F.conv(F.substring(digest, 1 + LANE_DIGITS * k, LANE_DIGITS), 16, 10).cast("long") for k, x in enumerate(_LANES)}


def _key(lanes: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", *[x.cast("string") for x in lanes]).cast("binary"), 256), 1, 40))


def prefix_rows(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent_key, n_bytes, ends) of every prefix of every conversation, the empty one included; equal keys and
    depths are equal sequences. ends: the prefix is the whole conversation."""
    own = turns.withColumns(_lanes())
    own = own.select("*", *[F.col(x).alias(f"own_{x}") for x in _LANES])
    summed = running_sums(own, "conv_id", ["pos"], _LANES)
    rows = summed.select(
        "conv_id", F.col("pos").alias("depth"), _key([F.col(x) for x in _LANES]).alias("key"),
        _key([F.col(x) - F.col(f"own_{x}") for x in _LANES]).alias("parent_key"), "n_bytes",
    )
    rows = rows.join(convs, "conv_id").select("conv_id", "depth", "key", "parent_key", "n_bytes", (F.col("depth") == F.col("n_turns")).alias("ends"))
    root = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), _key([F.lit(0)] * LANES).alias("key"), F.lit(None).cast("binary").alias("parent_key"),
        F.lit(0).cast("long").alias("n_bytes"), (F.col("n_turns") == 0).alias("ends"),
    )
    return rows.unionByName(root)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, key, ends_sha256) of pieces in order; only the digest of the node in hand is held."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["depth", "key", "ends_sha256"]
        )

    for batch in batches:
        done = []
        for depth, key, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, key) != node:
                if node:
                    done.append(row())
                node, digest = (depth, key), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        yield from done
    if node:
        yield row()


def members_digests(ends: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) per node of rows (depth, key, conv_id): SHA-256 of its conv_ids in ascending order, joined by commas.

    Ids are dealt by ranges, joined to one piece per node and range, and the pieces of a node are digested one after the other: a node
    with very many members is many tasks until its pieces, and never one row.
    """
    dealt = kept(ends.repartitionByRange("key", "depth", "conv_id").withColumn("_range", F.spark_partition_id()), "ends")
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = dealt.groupBy("depth", "key", "_range").agg(piece.alias("piece"))
    pieces = pieces.repartition("depth", "key").sortWithinPartitions("depth", "key", "_range").select("depth", "key", "piece")
    return pieces.mapInArrow(_digests, "depth long, key binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    convs: (conv_id, n_turns), ids unique and not null; turns: (conv_id, pos 1 to n_turns, digest, n_bytes). conv_id and depth tell a
    node: conv_id is its smallest member. n_convs counts members, n_children nodes one turn longer, n_leaves the childless nodes below
    it or it itself. saved_tokens sums (n_convs - 1) * n_bytes of the last turn over the node and all below. ends_sha256 is over members
    that end here. Conversations without turns are members of the root only. No conversations: no rows, not even a root.
    """
    prefixes = kept(prefix_rows(convs, turns), "prefixes")
    nodes = prefixes.groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("parent_key").alias("parent_key")
    )
    nodes = kept(nodes, "nodes")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(up, ["depth", "parent_key"], "left")
    tree = tree.withColumn("id", F.struct("conv_id", "depth"))
    parent = F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    tree = kept(tree.withColumn("parent", F.when(F.col("parent_conv_id").isNotNull(), parent)), "trie")
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    tree = kept(tree.join(children, "id", "left").fillna(0, ["n_children"]), "trie-children")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves")
    totals = subtree_totals(tree.select("id", "parent", leaf, ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    digests = members_digests(prefixes.where("ends").select("depth", "key", "conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    whole = tree.join(totals, "id").join(digests, ["depth", "key"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def query(spark, folder: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with a shared head."""
    conversations = spark.read.parquet(f"{folder.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(*with_shared_heads(numbered_turns(conversations)))


# A checksum by bits: a byte is mixed in, then eight steps (-1) shift it out.
_STEPS = "flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: list_concat([CAST(ascii(d) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
_CRC32 = f"""xor(4294967295, list_reduce({_STEPS}, lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END,
CAST(4294967295 AS BIGINT)))"""

SQL = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
 {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS own FROM t GROUP BY c),
cs AS (SELECT a.c, a.own, a.c - a.c % 5 AS base, a.h, least(a.h, coalesce(b.own, 0)) AS k FROM (SELECT *, {_CRC32} % 9 AS h FROM n) a LEFT JOIN n b ON b.c = a.c - a.c % 5),
r AS (SELECT cs.c, t.pos, said FROM cs JOIN t ON t.c = cs.base AND t.pos <= cs.h
 UNION ALL SELECT cs.c, t.pos - cs.h + cs.k, said FROM cs JOIN t ON t.c = cs.c AND t.pos > cs.h),
whole AS (SELECT cs.c, coalesce(turns, []) AS turns FROM cs LEFT JOIN (SELECT c, list(said ORDER BY pos) AS turns FROM r GROUP BY c) USING (c)),
pre AS (SELECT c, d, turns[1:d] AS p, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (SELECT d, p, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (ends), '')) AS e,
 CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].x) END AS saved FROM pre GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, p)),
up AS (SELECT a AS d, p[1:a] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
 FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT f.c AS conv_id, f.d AS depth, m.c AS parent_conv_id, f.n AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
 CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, f.e AS ends_sha256
FROM full_nodes f JOIN up USING (d, p) LEFT JOIN nodes m ON m.d = f.d - 1 AND m.p = f.p[1:f.d - 1]"""

QUERIES = {"op12_conversation_trie": (query, SQL)}
