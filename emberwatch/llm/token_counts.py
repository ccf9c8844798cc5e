"""Token counts that follow edits: a segment tree per document, of which only touched parts are encoded again.

Leaves are stretches of text whose ends are sure ends of pre-tokens (a visible character before, a blank or line break after), so
counts of leaves add up. A tree is two arrays in heap order, characters and tokens, node k above 2k and 2k + 1. An
edit finds its leaves by characters, widens them while an edge is no longer sure, encodes that region, and adds the
differences to the sums above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.byte_pairs import byte_ids
from emberwatch.llm.shared import documents

#: Least characters of a leaf.
LEAF_CHARS = 1024
TREE = "struct<chars: array<int>, tokens: array<int>>"
EDIT = "struct<start: int, removed: int, added: string>"

_SURE = re.compile(r"(?<=[!-~])(?=[ \n])")


def sure(text: str, at: int) -> bool:
    """Whether a pre-token surely ends at this place, whatever else the text holds."""
    return at == 0 or at == len(text) or ("!" <= text[at - 1] <= "~" and text[at] in " \n")


def leaf_lengths(text: str, least: int) -> list[int]:
    """Lengths of leaves of at least this many characters, the last one excepted; a long pre-token makes a long leaf."""
    edges = [0]
    while len(text) - edges[-1] > least:
        found = _SURE.search(text, edges[-1] + least)
        if not found:
            break
        edges.append(found.start())
    if edges[-1] < len(text) or len(edges) == 1:
        edges.append(len(text))
    return np.diff(edges).tolist()


class Tree:
    """Sums over leaves; ``size`` leaves fit, a power of two."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = list(chars), list(tokens)
        self.size = len(self.chars) // 2

    @classmethod
    def build(cls, lengths: list[int], counts: list[int]) -> Tree:
        size = 1
        while size < len(lengths):
            size *= 2
        out = cls([0] * (2 * size), [0] * (2 * size))
        for values, leaves in ((out.chars, lengths), (out.tokens, counts)):
            values[size : size + len(leaves)] = leaves
            for k in range(size - 1, 0, -1):
                values[k] = values[2 * k] + values[2 * k + 1]
        return out

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at``, and the leaf's first character."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        more, most = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += more
            self.tokens[k] += most
            k //= 2


def edit_tree(tree: Tree, text: str, start: int, removed: int, added: str, least: int) -> tuple[Tree, str, int]:
    """Tree and text after one edit, and the number of characters encoded for it. The edit is clipped to the text."""
    start = max(0, min(start, len(text)))
    removed = max(0, min(removed, len(text) - start))
    if not removed and not added:
        return tree, text, 0
    edited = text[:start] + added + text[start + removed :]
    first, low = tree.find(start)
    last, last_low = tree.find(max(start, start + removed - 1))
    high = last_low + tree.chars[tree.size + last]
    grown = len(added) - removed
    while first and not sure(edited, low):
        first -= 1
        low -= tree.chars[tree.size + first]
    while not sure(edited, high + grown):
        last += 1
        high += tree.chars[tree.size + last]
    region = edited[low : high + grown]
    lengths = leaf_lengths(region, least)
    counts, place = [], 0
    for n in lengths:
        counts.append(len(byte_ids(region[place : place + n])))
        place += n
    held = last - first + 1
    if len(lengths) > held:
        # More leaves than places: those that don't fit are one leaf, and a tree with such a leaf is laid out anew once it is long.
        lengths[held - 1 :] = [sum(lengths[held - 1 :])]
        counts[held - 1 :] = [sum(counts[held - 1 :])]
    for k in range(held):
        tree.put(first + k, lengths[k] if k < len(lengths) else 0, counts[k] if k < len(counts) else 0)
    spent = len(region)
    if max(lengths) > 16 * least and len(leaf_lengths(edited[low : low + sum(lengths)], least)) > 1:
        size = tree.size
        chars, tokens = tree.chars[size : 2 * size], tree.tokens[size : 2 * size]
        fresh = leaf_lengths(region, least)
        place, again = 0, []
        for n in fresh:
            again.append(len(byte_ids(region[place : place + n])))
            place += n
        spent += len(region)
        tree = Tree.build(chars[:first] + fresh + chars[last + 1 :], tokens[:first] + again + tokens[last + 1 :])
    return tree, edited, spent


def _tree_arrays(trees: list[Tree]) -> pa.Array:
    lists = [pa.array([t.chars for t in trees], pa.list_(pa.int32())), pa.array([t.tokens for t in trees], pa.list_(pa.int32()))]
    return pa.StructArray.from_arrays(lists, ["chars", "tokens"])


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """All columns of docs and ``tree``; its tokens[1] is the count of the text. Null texts count as empty: no tokens.

    ``tree`` replaces a column of that name. Ids are not looked at, so nulls and repeats are no matter.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py() or ""
                lengths, counts, place = leaf_lengths(text, leaf_chars), [], 0
                for n in lengths:
                    counts.append(len(byte_ids(text[place : place + n])))
                    place += n
                trees.append(Tree.build(lengths, counts))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, _tree_arrays(trees)], [f.name for f in batch.schema][:-1] + ["tree"])

    rest = docs.drop("tree")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.withColumn("tree", F.col(text_col)).mapInArrow(build, f"{fields}, tree {TREE}")


def apply_edits(docs: DataFrame, text_col: str = "text", edits_col: str = "edits", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Rows of build_trees with a list of edits, brought up to date: text, tree, and ``encoded_chars`` long.

    Edits apply in their order, each to the text the one before left; null or negative values count as 0 and ''. A
    null list leaves the row as it is, except that a null text becomes the empty text.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f.name for f in batch.schema]
            texts, trees, spent = [], [], []
            for text, tree, edits in zip(batch.column(text_col), batch.column("tree"), batch.column(edits_col), strict=True):
                text, held, total = text.as_py() or "", tree.as_py(), 0
                tree = Tree(held["chars"], held["tokens"])
                for e in edits.as_py() or []:
                    if e:
                        tree, text, n = edit_tree(tree, text, e["start"] or 0, e["removed"] or 0, e["added"] or "", leaf_chars)
                        total += n
                texts.append(text)
                trees.append(tree)
                spent.append(total)
            new = {text_col: pa.array(texts, pa.string()), "tree": _tree_arrays(trees), "encoded_chars": pa.array(spent, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names] + [new["encoded_chars"]], [*names, "encoded_chars"])

    rest = docs.drop("encoded_chars")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(apply, f"{fields}, encoded_chars long")


def own_edits(text):
    """Three edits of a text from itself: a cut, a repeat of its beginning, and a line put in the middle."""
    n = F.length(text)
    whole = lambda x: F.floor(x).cast("int")
    return F.array(
        F.struct(whole(n / 3).alias("start"), F.lit(40).alias("removed"), F.lit("").alias("added")),
        F.struct(whole(n / 5).alias("start"), F.lit(7).alias("removed"), F.substring(text, 1, 60).alias("added")),
        F.struct(whole(n / 2).alias("start"), F.lit(0).alias("removed"), F.lit("\nIt's 2 new lines.\n").alias("added")),
    )


def query(spark, folder: str) -> DataFrame:
    """Counts of all documents before and after edits of each."""
    trees = build_trees(documents(spark, folder, "doc_id", "text")).withColumn("n_tokens", F.expr("tree.tokens[1]").cast("long"))
    text = F.coalesce(F.col("text"), F.lit(""))
    edited = apply_edits(trees.withColumn("edits", own_edits(text)))
    return edited.select(
        "doc_id", "n_tokens", F.expr("tree.tokens[1]").cast("long").alias("n_tokens_edited"),
        F.length("text").cast("long").alias("n_chars_edited"), "encoded_chars",
    )


QUERIES = {"op2_token_counts": (query, None)}
